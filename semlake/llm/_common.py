"""Helpers shared by the operators: column access, content keys, written tables."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary, ref

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame

from ..scratch import drop_shared, shared_path

#: Rows, and bytes, of texts that are taken up at once.
TEXT_ROWS, TEXT_BYTES = 1000, 8 << 20
#: How Spark cuts the batches that it sends to Python, where the session does not say it itself.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: For each session the one that has its settings and ``BATCHES``, and back.
_BATCHED: WeakKeyDictionary = WeakKeyDictionary()
_OF: WeakKeyDictionary = WeakKeyDictionary()


def written(df: DataFrame, name: str, codec: str = "uncompressed") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage so that a lost executor costs no recomputation of what came
    before, and fixes values that would differ between two evaluations. Hashes and
    numbers gain little by a codec, whose buffers are outside of the heap; texts get one.
    """
    spark = _plain(df.sparkSession)
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, condition: Column | None = None) -> tuple[DataFrame, int]:
    """``written``, and how many of the rows fulfil the condition (all without one), counted while they are written.

    A task that runs twice may be counted twice: the number tells none from some.
    """
    seen = Observation()
    n = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return written(df.observe(seen, n.alias("n")), name), seen.get["n"]


#: Removes the tables written so far.
drop_written = drop_shared


def col(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that ``df`` has no column of, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def _pieces(batch):
    """A batch in slices of bounded rows and bytes; a row of more bytes is a slice of its own."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = batch.num_rows
    sizes = np.zeros(n, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < n:
        fits = int(np.searchsorted(upto, upto[at] + TEXT_BYTES, side="right")) - 1
        end = min(max(fits, at + 1), at + TEXT_ROWS, n)
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Memory that is free in this process goes back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def _plain(spark: SparkSession) -> SparkSession:
    """The caller's session, of one of ``_batched``."""
    found = _OF.get(spark)
    return (found and found()) or spark


def _batched(df: DataFrame) -> DataFrame:
    """``df`` in a session of its own, which has the settings of the caller's and ``BATCHES`` where that sets none.

    Spark reads the size of batches from the session when a frame is run, which may be long after it was made, and the caller's must not change.
    Frames of other kinds than Spark's own stay as they are.
    """
    if not isinstance(df, ClassicFrame):
        return df
    spark = _plain(df.sparkSession)
    own = _BATCHED.get(spark)
    if own is None:
        own = _BATCHED[spark] = spark.newSession()
        _OF[own] = ref(spark)
    wanted, has = {**BATCHES, **spark.conf.getAll}, own.conf.getAll
    for name, value in wanted.items():
        if has.get(name) != value and own.conf.isModifiable(name):
            own.conf.set(name, value)
    for name in has.keys() - wanted.keys():
        if own.conf.isModifiable(name):
            own.conf.unset(name)
    if df.sparkSession is own:
        return df
    name = f"texts_{uuid.uuid4().hex}"  # such views are how a frame gets from one session to another
    df.createGlobalTempView(name)
    try:
        return own.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{name}")
    finally:  # the frame has the plan, not the name
        spark.catalog.dropGlobalTempView(name)


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` for rows that hold whole texts.

    Spark holds a batch several times, outside of the heap, and the C library keeps room of that size for each thread;
    Python holds it, too. So batches are small (``BATCHES``), and ``run`` gets none of more than a slice, as what Python makes of a
    batch of texts is in memory several times over. A worker stays for later tasks and other stages, so it
    gives back what it has free when a task ends. The session's settings stay as they are; the frame has a session of
    its own with the same ones, until it is ``written``.
    """

    def sliced(batches):
        try:
            yield from run(piece for batch in batches for piece in _pieces(batch))
        finally:
            give_back()

    return _batched(df).mapInArrow(sliced, schema)


def local_frame(spark: SparkSession, **columns) -> DataFrame:
    """A frame of Arrow arrays that the driver holds.

    Of a list Spark makes an RDD, for which each executor starts Python workers besides those of ``mapInArrow``.
    """
    import pyarrow as pa

    return spark.createDataFrame(pa.table(columns))


def keys(*of: Column) -> list[Column]:
    """Two independent 64-bit hashes: a 128-bit key, for equality at any size."""
    return [F.xxhash64(*of), F.xxhash64(F.lit("b"), *reversed(of))]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_hash(df: DataFrame, at: str, n: int) -> list:
    """Rows of ``df`` with the smallest values of the 64-bit hash ``at``: ``n`` at most, one for each value.

    A cut by the hash comes first, so that tasks send little more than ``n`` rows
    altogether to the driver, however many tasks and repeated rows there are.
    """
    total = df.count()
    if not total or n <= 0:
        return []
    share = min(1.0, 1.25 * n / total + 200 / total)
    cut = min(int(share * 2**64) - 2**63, 2**63 - 1)
    rows = df.where(col(at) <= F.lit(cut)).dropDuplicates([at]).collect()
    return sorted(rows, key=lambda r: r[at])[:n]
