"""Token counts as an exact length histogram with suffix sums.

Documents are encoded whole and aggregated by encoded length. From the
histogram, suffix sums say for every length how many documents and tokens are
at or above it, and so the total, the quantiles and the truncated total of any
context limit, without going back to the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import col, map_texts, table, written

#: A folder of vocabularies; byte_bpe_50k.tiktoken is read from it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths of one block: suffix sums are taken over blocks, then within each.
BLOCK = 4096
_ENCODERS: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The byte-level BPE of this file, one for each process."""
    if path not in _ENCODERS:
        import base64
        import importlib.util
        import os

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        at = os.path.join(os.path.dirname(path), "__init__.py")
        spec = importlib.util.spec_from_file_location("tokenizer_files", at)
        files = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(files)
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, n_tokens): the exact number of tokens of each row's whole text; 0 for null and empty texts.

    Repeated rows each get their row, null ids too; texts of any length are encoded whole. Columns besides id and text are
    not looked at, whatever their names. No rows, no result.
    """
    rows = docs.select(col(id_col).alias("doc"), col(text_col).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc", "n_tokens"])

    return map_texts(rows, run, f"doc {kind}, n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each length."""
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """The histogram with docs_over, tokens_over (of longer documents), docs_total,
    tokens_total and truncated (all tokens left if each document is cut to n_tokens).

    Two levels: blocks of lengths are summed first, so no window holds more
    than ``block`` lengths or the number of blocks.
    """
    hist = written(hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / block).alias("block")), "histogram")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    everything = Window.partitionBy()
    above = everything.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"), F.sum("d").over(everything).alias("docs_total"), F.sum("t").over(everything).alias("tokens_total"))
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    docs_over = F.coalesce(F.sum("n_docs").over(within), F.lit(0)) + F.col("d")
    tokens_over = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(within), F.lit(0)) + F.col("t")
    out = hist.join(blocks, "block").select("n_tokens", "n_docs", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"), "docs_total", "tokens_total")
    return out.withColumn("truncated", F.col("tokens_total") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_over, truncated, lost) for each context limit, from the suffix sums.

    Between two lengths the answers follow from the smaller one: no document
    lies between. Below all lengths every document is cut. With no document
    at all everything is 0.
    """
    asked = sorted({int(x) for x in limits})
    below = [F.max(F.when(F.col("n_tokens") <= x, F.struct("n_tokens", "docs_over", "tokens_over"))).alias(f"b{x}") for x in asked]
    one = sums.agg(F.max("docs_total").alias("d"), F.max("tokens_total").alias("t"), *below)
    rows = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("context"), F.col(f"b{x}").alias("b")) for x in asked]))
    out = one.select("d", "t", rows.alias("r")).select("d", "t", "r.context", "r.b")
    over, tokens = F.coalesce("b.docs_over", "d", F.lit(0)), F.coalesce("b.tokens_over", "t", F.lit(0))
    total = F.coalesce("t", F.lit(0))
    kept = total - tokens + F.col("context") * over
    return out.select("context", over.alias("docs_over"), kept.alias("truncated"), (total - kept).alias("lost"))


def quantiles(sums: DataFrame, of: list[float]) -> DataFrame:
    """(q, n_tokens): the smallest length that at least the share q of documents does not exceed; no row without documents."""
    within = F.col("docs_total") - F.col("docs_over")
    answers = sums.agg(*[F.min(F.when(within >= F.lit(q) * F.col("docs_total"), F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(of)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(of)]))
    return answers.select(rows.alias("r")).select("r.q", "r.n_tokens").where("n_tokens is not null")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(count_tokens(table(spark, sf_dir, "documents"))))
