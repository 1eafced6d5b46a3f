"""Near copies by SimHash, checked by and completed to the Jaccard similarity of five-word shingles.

Two texts link if their sets of shingles have a similarity of ``NUM / DEN`` at
least. Three steps, of which none loses a link:

1. Sets that can link with no other go. In any order of the shingles, two sets that link
   share ``SEVERAL`` among the first n - ceil(0.8 n) + ``SEVERAL`` of each, so a set with fewer there that
   another set has is alone. Of the others whole sets are made; those of which less than 0.8 is shared go.
2. SimHash: fingerprints of what is left meet in the buckets of a covering family for ``RADIUS`` bits (``simhash.candidates``), pairs
   are compared set by set, and what links is connected.
3. At 0.8 about 15 % of a SimHash's bits differ however wide it is, and no family of a few tables covers
   such a share. The links with more differing bits are found by a prefix filter, the rarest shingles first: sets that link share one
   among the first n - ceil(0.8 n) + 1. Its place and the sizes bound the overlap; what passes, and is not connected yet, is compared set by set.

Equal sets are one vertex. In the last step all sets of a shingle are first compared with one of them,
which is linear; then, in shingles of many sets that are not connected yet, with another one; what is left, of different
components and not compared yet, is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from ._common import col, counted, fresh, keys, map_texts, written
from ._graph import components

#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: Sets of a shingle up to which what is left after the first comparison is compared pair by pair.
PAIRS = 32
#: Times that all of a larger one is compared with another of its sets before that.
ROUNDS = 2
#: Keys of texts that are sent to every task at most, 16 bytes each; with more of them both sides are shuffled.
BROADCAST_KEYS = 1 << 21
#: Differing bits of a fingerprint up to which SimHash finds pairs.
RADIUS = 6
#: How many shared shingles the first look at a set asks for.
SEVERAL = 24
#: Documents whose shingles are counted for the order, and how many of these must have one that comes late.
SAMPLE, OFTEN = 8000, 3
#: Shingles that come late at most. More would only be ordered as the others are.
LATE = 100_000


def shingles(text: bytes | None, size: int):
    """The different shingles' hashes, sorted; words are as in ``simhash.fingerprints``."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.int64)
    parts = {b" ".join(words)} if len(words) < size else set(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    return np.unique(np.fromiter((digest(s, 42) for s in parts), np.uint64, len(parts)).view(np.int64))


def prefix(n: int) -> int:
    """Of how many shingles two sets that link must share one, in a set of ``n``."""
    return n + NUM * -n // DEN + 1 if n else 0


def several(n: int) -> int:
    """How many shingles sets that link share among the first ``prefix(n) - 1`` and as many more."""
    return min(SEVERAL, n - prefix(n) + 1) if n else 0


def _mapper(size: int, late: list[int] | None):
    """(a, b, sig, n, fp, toks): the prefix of several in order, or without ``late`` the whole set and its fingerprint."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest as digest

        if late:
            by = np.argsort(np.array(late, np.int64))
            known = np.array(late, np.int64)[by]
        for batch in batches:
            sigs, ns, fps, toks = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = shingles(text, size)
                n = len(found)
                sigs.append(int(np.uint64(digest(found.tobytes(), 7)).view(np.int64)))
                ns.append(n)
                fps.append(simhash.of_hashes(found) if late is None else None)
                if late:
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    found = found[np.argsort(np.where(known[at] == found, by[at] + 1, 0), kind="stable")]
                toks.append(found if late is None or not n else found[: prefix(n) + several(n) - 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sigs, pa.int64()), pa.array(ns, pa.int32()), pa.array(fps, pa.int64()), pa.array(toks, pa.list_(pa.int64()))], ["a", "b", "sig", "n", "fp", "toks"]
            )

    return run


_SHAPE = "a long, b long, sig long, n int, fp long, toks array<long>"


def _late(rows: DataFrame, size: int) -> list[int]:
    """Shingles that several documents of a sample have, the rarest first."""
    total = rows.count()
    if not total:
        return []
    cut = min(int(min(1.0, SAMPLE / total) * 2**64) - 2**63, 2**63 - 1)
    found = map_texts(rows.where(F.col("a") <= F.lit(cut)), _mapper(size, None), _SHAPE).select(F.explode("toks").alias("tok"))
    found = written(found.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= OFTEN), "late")
    most = found.orderBy(F.col("df").desc(), "tok").limit(LATE).collect()
    return [r["tok"] for r in sorted(most, key=lambda r: (r["df"], r["tok"]))]


def _fits(n: str, i: str, m: str, j: str) -> Column:
    """Whether sets of ``n`` and ``m`` whose first shared shingle is at ``i`` and ``j`` can link."""
    return F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) * (NUM + DEN) >= (F.col(n) + F.col(m)) * NUM


def _least() -> Column:
    """How many shingles of a set of ``n`` any other that links must have."""
    return F.ceil(F.col("n") * NUM / DEN)


def _shared(sets: DataFrame) -> DataFrame:
    """The sets (sig, n, fp, toks) with the shingles that another of them has, the rarest first; sets with too few go. A set may be there twice."""
    by = Window.partitionBy("tok")
    toks = sets.select("sig", F.explode("toks").alias("tok"))
    toks = toks.select("sig", "tok", F.count(F.lit(1)).over(by).alias("df"), F.min("sig").over(by).alias("r"), F.max("sig").over(by).alias("s")).where("r <> s")
    found = toks.groupBy("sig").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("df", "tok")))["tok"]).alias("toks"))
    found = found.join(sets.select("sig", "n", "fp").distinct(), "sig")
    return written(found.where(F.size("toks") >= _least()).select("sig", "n", "fp", "toks"), "sets")


def _able(rows: DataFrame, placed: DataFrame, size: int) -> DataFrame:
    """(sig, n, fp, toks): the different sets that may link with another, whole but for shingles that none of the others has, the rarest first."""
    reps = placed.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("toks").alias("toks"), F.min(F.struct("a", "b")).alias("row"))
    reps = written(reps, "sets")
    toks = reps.select("sig", F.explode("toks").alias("tok"))
    shared = written(toks.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("tok"), "shared")
    met = written(toks.join(shared, "tok").groupBy("sig").agg(F.count(F.lit(1)).alias("met")), "met")
    some = reps.join(met, "sig").where(F.col("met") >= F.least(F.lit(SEVERAL), _least()))
    chosen, n = counted(some.select("row.a", "row.b"), "chosen")
    if n <= BROADCAST_KEYS:  # texts stay where they are
        chosen = F.broadcast(chosen)
    sets = map_texts(rows.join(chosen, ["a", "b"], "left_semi"), _mapper(size, None), _SHAPE).select("sig", "n", "fp", "toks")
    return _shared(_shared(written(sets, "whole")))


def _linked(rows: DataFrame, placed: DataFrame, size: int) -> DataFrame:
    """(v, root): components of the sets ``sig`` of ``placed`` as all pairs that link would make them; those without a link are left out."""
    sets = _able(rows, placed, size)

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs (x, y) whose sets link, written."""
        pairs = written(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
        one, two = (sets.select(F.col("sig").alias(e), F.col("n").alias("n" + e), F.col("toks").alias("of" + e)) for e in ("a", "b"))
        same = F.size(F.array_intersect("ofa", "ofb")) * (NUM + DEN) >= (F.col("na") + F.col("nb")) * NUM
        return written(pairs.join(one, "a").join(two, "b").where(same).select("a", "b"), "linked")

    roots = components(verified(_alike(sets)))
    alone = F.col("n") - F.size("toks")  # come first
    toks = sets.select("sig", "n", alone.alias("alone"), F.posexplode(F.slice("toks", F.lit(1), F.col("n") - _least().cast("int") + 1 - alone)).alias("i", "tok"))
    toks = written(toks.select("tok", "sig", "n", (F.col("alone") + F.col("i")).alias("i")), "prefixes")
    left = toks.join(toks.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "tok")
    fits = _fits("n", "i", "m", "j")
    for k in range(ROUNDS + 2):
        # shingles whose sets are connected are done with
        placed = left.join(roots, left["sig"] == roots["v"], "left").select("tok", "sig", "n", "i", "df", F.coalesce(roots["root"], "sig").alias("root"))
        placed = written(placed, "rest")
        mixed = placed.groupBy("tok").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("tok")
        left, n = counted(placed.join(mixed, "tok"), "left")
        if not n:
            return roots
        of = left if k == 0 else left.where(F.col("df") > PAIRS)
        if 0 < k <= ROUNDS and of.isEmpty():
            left = left.drop("root")
            continue
        # every shingle's sets with one of them, the smallest by another order each time; at last those that are left with each other
        if k <= ROUNDS:
            order = F.col("sig") if k == 0 else F.xxhash64("sig", F.lit(k))
            far = of.groupBy("tok").agg(*[F.min_by(c, order).alias(d) for c, d in (("sig", "y"), ("n", "m"), ("i", "j"), ("root", "to"))])
            far = written(far, "pivots")
            pairs = of.join(far, "tok").where((F.col("sig") != F.col("y")) & fits)
        else:
            far = left.select("tok", F.col("sig").alias("y"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("to"))
            pairs = left.join(far, "tok").where((F.col("sig") < F.col("y")) & fits)
        pairs = pairs.where(F.col("root") != F.col("to"))
        roots = _joined(roots, verified(pairs.select(F.col("sig").alias("x"), "y")))
        # so is what has been compared with all of its shingle
        left = left.join(far.select("tok", "y"), "tok", "left").where(F.col("y").isNull() | (F.col("sig") != F.col("y"))).drop("y", "root") if k <= ROUNDS else left
    return roots


def _alike(sets: DataFrame) -> DataFrame:
    """(x, y): pairs of sets whose SimHash fingerprints differ in ``RADIUS`` bits at most; sets of one fingerprint are each paired with the least."""
    of = written(sets.groupBy("fp").agg(F.min("sig").alias("least")), "fingerprints")
    near = simhash.candidates(of.select("fp"), RADIUS)
    near = near.join(of.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    same = sets.select("fp", F.col("sig").alias("x")).join(of, "fp").where(F.col("x") != F.col("least"))
    return near.select("x", "y").unionByName(same.select("x", F.col("least").alias("y")))


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The components (v, root) with further edges (a, b) between their vertices, or new ones."""
    for end in ("a", "b"):
        of = roots.select(F.col("v").alias(end), F.col("root").alias("at"))
        more = more.join(of, end, "left").withColumn(end, F.coalesce("at", end)).drop("at")
    further = components(more)
    joined = roots.join(further.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    return written(joined.unionByName(further.join(roots, "v", "left_anti")), "roots")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with exactly one row of each component of linked texts, all columns under their names.

    Of the smallest id the row of the smallest hash of id and text stays, null ids
    only where there are no others; of rows that repeat id and text the one of the smallest
    hash of all columns. One id on texts of different components stays once in
    each. Texts of fewer than ``shingle`` words are one shingle; null texts and texts
    without words are copies of each other.
    """
    a, b = keys(col(id_col).isNull(), col(id_col), col(text_col).isNull(), col(text_col))
    rows = docs.select(a.alias("a"), b.alias("b"), col(text_col).alias("text"))
    placed = written(map_texts(rows, _mapper(shingle, _late(rows, shingle)), _SHAPE), "placed")
    roots = _linked(rows, placed, shingle)
    ids = docs.select(a.alias("a"), b.alias("b"), col(id_col).alias("doc")).groupBy("a", "b").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"))
    each = ids.join(placed.select("a", "b", "sig").distinct(), ["a", "b"])
    each = written(each.join(roots, each["sig"] == roots["v"], "left").select("a", "b", "doc", "copies", F.coalesce("root", "sig").alias("root")), "each")
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "a", "b")).alias("f"))
    first = written(first.select(F.col("f.a").alias("a"), F.col("f.b").alias("b"), F.lit(True).alias("first")), "first")
    judged, n = counted(each.join(first, ["a", "b"], "left").where(F.col("first").isNull() | (F.col("copies") > 1)).select("a", "b", F.coalesce("first", F.lit(False)).alias("first")), "judged")

    k1, k2, one = fresh(docs, "k1", "k2", "one")
    tagged = docs.withColumn(k1, a).withColumn(k2, b)
    of = judged.withColumnsRenamed({"a": k1, "b": k2})
    gone = of.drop("first")
    out = tagged.join(F.broadcast(gone) if n <= BROADCAST_KEYS else gone, [k1, k2], "left_anti").drop(k1, k2)
    again = of.where("first").drop("first")
    if again.isEmpty():
        return out
    columns = [col(c) for c in docs.columns]
    picked = tagged.join(again, [k1, k2]).groupBy(k1, k2).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(one))
    return out.unionByName(picked.select(*[F.col(one)[c].alias(c) for c in docs.columns]))
