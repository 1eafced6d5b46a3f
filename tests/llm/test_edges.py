"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import pytest

from semlake.llm import chat, decontaminate, line_dedup, media, pieces, quality, secret_scan, simhash, token_counts, url_filter

LONG = "word " * 60_000 + "\n" + "x" * 50_000
TEXTS = [(1, None), (2, ""), (3, "a b c\nd e f\ng h i\nj"), (3, "a b c\nd e f\ng h i\nj"), (4, "a b c\nd e f\ng h i\nk"), (None, "token = abcdef12"), (5, LONG), (6, "漢字 ê\u2028 \U0001F600")]
EXTRA = "doc string, a string, b string, k1 string, gone string, `row` string, `key` string, `x.y` string, N_LINES string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*t, *["z"] * 11) for t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a b c d e f g h"), (2, "word word"), (None, "a b"), (3, None), (4, "!!")], "item_id long, text string")


def all_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(docs, stats=True)
    assert out.count() == len(TEXTS)
    assert "x.y" in out.columns and out.columns.count("n_lines") == 1 and "N_LINES" not in out.columns
    got = {(r.doc_id, r.text, r.n_removed) for r in out.collect()}
    assert (1, None, 0) in got and (2, "", 0) in got and (4, "k", 3) in got and (3, TEXTS[2][1], 0) in got
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_line_dedup_keeps_each_line_once(spark):
    texts = ["a\na\na\na\na\na", "a\na\na", "x\ny\nx\ny\nx\ny\nx", "\n\n\n\n", "\n\n\n"]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out[0] == "a" and out[1] == "" and set(out[2].split("\n")) == {"x", "y"} and out[3] == "\n\n\n\n" and out[4] == "\n\n\n"


def test_decontamination(docs, empty, items):
    out = decontaminate.contamination(docs, items)
    assert out.count() == len(TEXTS)
    by = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out.collect()}
    assert (1, 0, 0, ()) in by and (2, 0, 0, ()) in by and (3, 10, 8, ("1",)) in by and (5, 60_001, 60_000, ("2",)) in by
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("n_items > 0").count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "6", "None"]


def test_secret_scan(docs, empty):
    out = {(r.doc_id, r.n_assign, r.base) for r in secret_scan.scan(docs).collect()}
    assert (None, 1, "assign:0:16") in out and (1, 0, "") in out
    assert secret_scan.scan(docs).count() == len(TEXTS) and secret_scan.scan(empty).count() == 0


def test_simhash(docs, empty):
    out = simhash.near_duplicates(docs)
    rows = {(r.doc_id, r.fingerprint, r.component_id) for r in out.collect()}
    assert out.count() == len(TEXTS) and (1, "0" * 16, 1) in rows and (2, "0" * 16, 1) in rows
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()).count("3") == 2


def test_pieces(docs, empty):
    out = pieces.sample(docs)
    back = pieces.decode(out).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t or "") for i, t in TEXTS}
    assert pieces.sample(empty).count() == 0
    assert all_rows(pieces.sample(docs.where("doc_id = 3"), digest=True).where("rank = 1").select("ids_sha256").distinct())[0]


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    scorer = quality.fit(docs, labels)
    out = quality.score(docs, scorer)
    assert out.count() == len(TEXTS) and {r.keep for r in out.where("doc_id in (1, 2)").collect()} == {True}
    assert quality.keep_good(docs, scorer).columns == docs.columns
    nothing = quality.fit(empty)
    assert quality.score(empty, nothing).count() == 0 and quality.score(docs, nothing).where("keep").count() == len(TEXTS)


def test_token_counts(docs, empty):
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.count_tokens(docs)))
    assert sums.agg({"n_docs": "sum"}).first()[0] == len(TEXTS)
    none = token_counts.suffix_sums(token_counts.histogram(token_counts.count_tokens(empty)))
    assert none.count() == 0 and token_counts.quantiles(none, [0.5]).count() == 0
    assert [tuple(r) for r in token_counts.at_limits(none, [4]).collect()] == [(4, 0, 0, 0)]


def test_media(docs, empty):
    held = media.inspect(media.store(docs, "text"))
    assert held.count() == len({t or "" for _, t in TEXTS})
    out = media.resolve(media.sequences(media.reference(docs), "doc", "html"), held)
    assert out.where("digest is not null").count() == 2 * len(TEXTS) and out.where("digest is not null and payload_sha256 is null").count() == 0
    assert media.inspect(media.store(empty, "text")).count() == 0


def test_urls(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://ORG/"), (5, "http://ORG/"), (6, "http://a.org?x#y"), (7, "http://é.Example.org/en/1" + "z" * 100_000)]
    pages = spark.createDataFrame([(*u, "s", "h", 1) for u in urls], "page_id long, url string, suffix string, host string, score int")
    got = {r.page_id: (r.host, r.path[:6], r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[1][:3] == got[2][:3] == got[3][:3] == got[4][:3] == ("", "", None)
    assert got[5] == ("org", "/", "org/", "allow") and got[6][:3] == ("a.org", "", None) and got[7] == ("é.example.org", "/en/1z", "example.org/en/1", "block")
    assert url_filter.judge(pages).count() == len(urls) and url_filter.judge(pages.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, None, None, None), (1, 0, "", "user"), (1, 1, "Assistant: hi", "assistant"), (1, 1, "Assistant: hi", "assistant"), (None, 5, "x?", "alien"), (2, 0, "a\n" * 50_000, None)]
    turns = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, text string, role string, stretch string, i int")
    out = chat.recover(turns)
    assert out.count() == len(rows) and {r.role for r in out.collect()} <= set(chat.STATES)
    assert out.where("rendered like '%Assistant:%'").count() == 0
    assert chat.recover(turns.limit(0)).count() == 0
