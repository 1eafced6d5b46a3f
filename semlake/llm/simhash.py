"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint bit is set if over half of a text's shingle hashes have it. Two
fingerprints link if they differ in at most ``radius`` bits. The candidate
search is a covering family: bit i gets a nonzero vector m(i) over GF(2) of
``radius + 1`` dimensions, and table v masks the fingerprint to the bits with
<m(i), v> = 1. Any ``radius`` differing bits span fewer dimensions than there
are, so some nonzero v is orthogonal to all of them and the pair collides in
table v: no pair within the radius is missed.

Distinct fingerprints meet in buckets (table, masked fingerprint). A bucket of
up to ``PAIRS`` of them is compared pair by pair. In a larger one each
fingerprint is linked to the values within half the radius instead: two of them
share such a value exactly if they are within the radius, which is linear in
the bucket and as exact.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, fresh, keys, map_texts, table, written
from ._graph import components

#: Fingerprints of a bucket up to which its pairs are compared.
PAIRS = 32
#: Hashes whose bits are counted at once.
STEP = 1 << 14


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks of the covering family, as signed 64-bit integers."""
    vectors = (1 << radius + 1) - 1
    step = 1 + vectors // 64  # of more vectors than bits the odd ones, so that no mask has few bits
    of = [i * step % vectors + 1 for i in range(64)]
    return [_signed(sum(1 << i for i in range(64) if (of[i] & v).bit_count() & 1)) for v in range(1, vectors + 1)]


def ball(radius: int) -> list[int]:
    """What to xor a fingerprint with for all values within ``radius`` bits of it."""
    return [_signed(sum(1 << i for i in c)) for k in range(radius + 1) for c in combinations(range(64), k)]


def ones(hashes):
    """How many of the 64-bit hashes set each bit."""
    import numpy as np

    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts, n: int) -> int:
    """The signed fingerprint of ``n`` hashes whose ``ones`` are counted: bits that over half of them set."""
    import numpy as np

    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def of_hashes(hashes) -> int:
    """The signed fingerprint of an array of hashes, zero of none."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        counts += ones(hashes[at : at + STEP])
    return majority(counts, len(hashes))


def _fingerprinter(shingle: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest as digest

        def fingerprint(text: bytes) -> int:
            words = text.lower().split()  # of bytes: A-Z only, and x20, x09-x0D
            n = len(words) - shingle + 1
            if not words:
                return 0
            if n < 1:
                parts, n = [b" ".join(words)], 1
            else:
                parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
            counts = np.zeros(64, np.int64)
            for at in range(0, n, STEP):
                part = parts[at : at + STEP]
                counts += ones(np.fromiter((digest(s, 42) for s in part), np.uint64, len(part)))
            return majority(counts, n)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t or b"") for t in texts], pa.int64())], ["doc", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc, fp): the id and the signed 64-bit fingerprint of each row's whole text.

    A-Z are lower-cased, words are runs without x20 and x09-x0D, shingles are
    ``shingle`` words joined by blanks and hashed by XXH64 (seed 42), repeats
    included. Fewer words are one shingle; no word, as in null and empty
    texts, is fingerprint zero.
    """
    rows = docs.select(col(id_col).alias("doc"), col(text_col).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return map_texts(rows, _fingerprinter(shingle), f"doc {kind}, fp long")


def _buckets(found: DataFrame, radius: int) -> DataFrame:
    """(v, key, fp, n): the distinct fingerprints ``fp`` in each table's buckets of ``n``, those alone left out."""
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(masks(radius))])
    keyed = written(found.select("fp", F.explode(tables).alias("t")).select("t.v", "t.key", "fp"), "keyed")
    shared = written(keyed.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    return written(keyed.join(shared, ["v", "key"]), "met")


def links(found: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` within ``radius`` bits.

    A large bucket's edges go through values that need not be fingerprints."""
    if radius < 2 or radius % 2:
        raise ValueError("the radius is 2, 4, ...: a large bucket halves it")
    met = _buckets(found, radius)
    small, large = met.where(F.col("n") <= PAIRS), met.where(F.col("n") > PAIRS)
    other = small.select("v", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius
    pairs = small.join(other, ["v", "key"]).where((F.col("fp") < F.col("b")) & near).select(F.col("fp").alias("a"), "b")
    around = F.array(*[F.lit(x) for x in ball(radius // 2)])
    spokes = large.select("fp").distinct().select(F.col("fp").alias("a"), F.explode(F.transform(around, lambda x: F.col("fp").bitwiseXOR(x))).alias("b"))
    return pairs.unionByName(spokes)


def candidates(found: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` within ``radius`` bits, for a check of each that follows.

    Each fingerprint of a bucket is paired with the bucket's least, which is linear. Pairs of others are left out
    and the caller's to find, where they do not meet the same one.
    """
    met = _buckets(found, radius)
    least = met.groupBy("v", "key").agg(F.min("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius
    return met.join(least, ["v", "key"]).where((F.col("fp") != F.col("a")) & near).select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(``id_col``, fingerprint, component_id), one row for each row of ``docs``.

    fingerprint is 16 lower-case hex digits; component_id is the smallest id that
    can be reached through links, the row's own included. Null ids take part but
    are no component's smallest; a component of null ids only has none. Repeated
    rows each get their row. Texts without words have fingerprint zero and are
    linked like any other. Texts are taken whole, very long ones in stretches of shingles. No rows, no result. Columns besides id and text are not looked at.
    """
    each = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    found = written(each.groupBy("fp").agg(F.min("doc").alias("least")), "distinct")
    roots = components(links(found, radius))
    placed = written(found.join(roots, found["fp"] == roots["v"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    least = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    placed = written(placed.join(least, "root").select("fp", "component_id"), "components")
    return each.join(placed, "fp").select(F.col("doc").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _placed(docs: DataFrame, text_col: str, of: list[str], shingle: int, radius: int) -> DataFrame:
    """The columns ``of`` of each row, with its fingerprint's component ``root``."""
    row = F.struct(*of)
    each = written(fingerprints(docs.select(row.alias("row"), col(text_col).alias("text")), "row", "text", shingle), "fingerprints")
    roots = components(links(written(each.select("fp").distinct(), "distinct"), radius))
    return each.join(roots, each["fp"] == roots["v"], "left").select("doc.*", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with the document of the smallest id of each component.

    A row is known by its id and text: one id on texts of different components stays
    in each, unless a smaller id is there. Rows that repeat id and text are one document and stay or go together. Null ids
    come after all others; of a component of null ids only, the text of the smallest hash stays. Other columns pass through under their names.
    """
    a, b = keys(col(id_col).isNull(), col(id_col), col(text_col).isNull(), col(text_col))
    k1, k2 = fresh(docs, "k1", "k2")
    distinct = docs.select(a.alias("a"), b.alias("b"), col(id_col).alias("doc"), col(text_col).alias("text")).dropDuplicates(["a", "b"])
    each = written(_placed(distinct, "text", ["a", "b", "doc"], shingle, radius), "each")
    least = each.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "a", "b")).alias("f"))
    kept = written(least.select(F.col("f.a").alias(k1), F.col("f.b").alias(k2)), "kept")
    return docs.withColumn(k1, a).withColumn(k2, b).join(kept, [k1, k2], "left_semi").select(*[col(c) for c in docs.columns])


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

