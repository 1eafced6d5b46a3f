"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

Each run of 8 consecutive words of a benchmark item is a window. Its words are
ordered by how rare they are in the corpus; for containment of the whole window
one word suffices as prefix, so only its rarest word is joined with the words
of the documents. Where that word stands, length and positional bounds say
whether the window fits, and the words around are compared one by one.

The documents are read twice (once to count the benchmark's own words, once to
join), and no word of theirs is shuffled: the benchmark's tables are sent to
every task, in as many blocks of bounded size as they need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, col, fresh, keys, table, written

#: Runs of what is no word; A-Z are letters here, as they are lower-cased later, word by word.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows, and bytes of text, of the benchmark's tables that are sent to every task at once; more go in blocks, each against all documents.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK, -1), "")


def _blocks(df: DataFrame, by: str) -> list[DataFrame]:
    """The rows in broadcast blocks of about ``BROADCAST_ROWS`` and ``BROADCAST_BYTES``, one at least."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "string"]
    said = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(sum(texts, F.lit(0)).cast("long")).alias("bytes")).first()
    n = max(-(-said["rows"] // BROADCAST_ROWS), -(-(said["bytes"] or 0) // BROADCAST_BYTES))
    return [F.broadcast(df.where(F.pmod(F.xxhash64(by), F.lit(n)) == i) if n > 1 else df) for i in range(max(n, 1))]


def _judged(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 8) -> DataFrame:
    """Each row's key (a, b), doc, n, n_hit, items, full (how many of the items by a window of ``size`` words)."""
    bench = items.select(col(item_col).cast("string").alias("item"), F.transform(_words(col(item_text_col)), ascii_lower).alias("w"))
    bench = bench.where(F.col("item").isNotNull() & (F.size("w") > 0))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))), lambda i: F.slice("w", i, size))
    windows = written(bench.select("item", F.explode(spans).alias("win")).withColumn("key", F.sha2(F.to_json("win"), 256)), "windows")

    a, b = keys(col(id_col), col(text_col))
    texts = docs.select(col(id_col).alias("doc"), a.alias("a"), b.alias("b"), _words(col(text_col)).alias("words"))
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    seen = texts.select(F.explode_outer("words").alias("raw")).select(ascii_lower(F.col("raw")).alias("word"))
    counts = [seen.join(block, "word").groupBy("word").agg(F.count(F.lit(1)).alias("df")) for block in _blocks(vocabulary, "word")]
    counts = written(reduce(DataFrame.unionByName, counts), "counts")

    # the rarest word of each window, and where in it that stands; a word that no document has rules the window out
    tokens = windows.select("key", "win").dropDuplicates(["key"]).select("key", "win", F.posexplode("win").alias("off", "word"))
    tokens = tokens.join(counts, "word", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "off")).alias("t"), F.first("win").alias("win")).where("t.df > 0")
    prefix = tokens.select("key", F.col("t.word").alias("word"), F.col("t.off").alias("off"), F.size("win").alias("len"), F.array_join("win", " ").alias("said"))

    # one more entry of each document that always matches and carries its length; no word is like it
    mark = " "
    always = docs.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(mark).alias("word"), F.lit(1).alias("off"), F.lit(0).alias("len"), F.lit("").alias("said"))
    places = texts.select(F.monotonically_increasing_id().alias("row"), "doc", "a", "b", F.size("words").alias("n"), "words").select("row", "doc", "a", "b", "n", "words", F.posexplode(F.concat(F.array(F.lit(mark)), "words")).alias("at", "raw"))
    places = places.withColumn("word", ascii_lower(F.col("raw")))
    # only expressions that are compiled: join and generator then stay one loop, which copies no document's words for each of them
    start = F.col("at") - 1 - F.col("off")
    around = ascii_lower(F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")), " "))
    fits = (start >= 0) & (start + F.col("len") <= F.col("n")) & (around == F.col("said"))
    found = [places.join(F.broadcast(block.unionByName(always)) if i == 0 else block, "word").where((F.col("key") == "") | fits).select("row", "doc", "a", "b", "n", "key", start.alias("start"), "len") for i, block in enumerate(_blocks(prefix, "key"))]
    found = written(reduce(DataFrame.unionByName, found), "found")

    hits = found.where("key <> ''")
    covered = hits.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("p")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    of = windows.select("key", "item").distinct()
    which = hits.select("row", "key", "len").distinct().join(of, "key").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"), F.size(F.collect_set(F.when(F.col("len") >= size, F.col("item")))).alias("full"))
    out = found.where("key = ''").select("row", "a", "b", "doc", "n").join(covered, "row", "left").join(which, "row", "left")
    return out.select("a", "b", "doc", "n", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("full", F.lit(0)).alias("full"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 8, at_least: int = 2) -> DataFrame:
    """For each row of ``docs``: its id, n_words, n_hit, n_items, items (sorted
    array of item ids as strings), contaminated (n_items >= ``at_least``).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. An
    item of fewer than ``size`` words, but not none, is one window. Null and
    empty texts have no words and no hit; items without words or with a null id
    occur nowhere. Repeated rows of ``docs`` each get a row of their own; item
    ids repeated in ``items`` count once. Other columns are not looked at.
    """
    out = _judged(docs, items, id_col, text_col, item_col, item_text_col, size)
    n_items = F.size("items")
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), n_items.cast("long").alias("n_items"), "items", (n_items >= at_least).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 8, at_least: int = 1, at_least_short: int = 1) -> DataFrame:
    """``docs`` without the rows in which windows of ``size`` words of ``at_least`` items occur, or windows
    of ``at_least_short`` items if shorter ones count, all columns under their names.

    An item of fewer than ``size`` words is one shorter window; a common word is no leak by itself, which ``at_least_short`` above 1 allows for.

    A row is known by its id and text, so rows that share an id are judged each on
    its own text. Nulls and short texts are as in ``contamination``.
    """
    bad = written(_judged(docs, items, id_col, text_col, item_col, item_text_col, size).where((F.col("full") >= at_least) | (F.size("items") >= max(at_least, at_least_short))).select("a", "b").distinct(), "contaminated")
    k1, k2 = fresh(docs, "k1", "k2")
    a, b = keys(col(id_col), col(text_col))
    return docs.withColumn(k1, a).withColumn(k2, b).join(bad.withColumnsRenamed({"a": k1, "b": k2}), [k1, k2], "left_anti").drop(k1, k2)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, least(len(w), 8) l, array_to_string(w[p:p + 7], ' ') t from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) p from iw where len(w) > 0)),
sizes as (select distinct l from win),
dg as (select doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') t from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) p from dw, sizes where len(w) >= l)),
m as (select doc_id, item_id, p, dg.l from dg join win on win.t = dg.t and win.l = dg.l),
h as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + l)) q from m) group by doc_id),
i as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) ids from (select distinct doc_id, cast(item_id as varchar) s from m) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from dw left join h using (doc_id) left join i using (doc_id)
"""
