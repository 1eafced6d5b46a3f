"""The operators as queries over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, line_dedup, media, pieces, quality, secret_scan, simhash, token_counts, url_filter

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_media_columns": media.op2_media_columns,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_piece_samples": pieces.op4_piece_samples,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_chat_format": chat.op6_chat_format,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_simhash": simhash.op9_simhash,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

SQL = {
    "op3_secret_scan": secret_scan.OP3_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
