"""Slices of batches, counts while writing, and what the pipeline leaves behind."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from semlake import scratch
from semlake.llm import _common


def test_slices_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(_common, "TEXT_BYTES", 100)
    monkeypatch.setattr(_common, "TEXT_ROWS", 7)
    texts = [None, "", "x" * 1000, *["ab"] * 30, "y" * 99, "z" * 2, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    slices = list(_common._pieces(batch))
    assert [x for s in slices for x in s.column(1).to_pylist()] == texts
    assert all(s.num_rows <= 7 and (s.num_rows == 1 or sum(len(t or "") for t in s.column(1).to_pylist()) <= 100) for s in slices)
    assert list(_common._pieces(batch.slice(0, 0))) == []


def test_settings_of_the_session_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    _common.map_texts(spark.createDataFrame([("a",)], "t string"), lambda batches: batches, "t string").collect()
    assert spark.conf.get(name) == before


def _seen(df):
    """Of each slice that ``map_texts`` gives: its rows and the bytes that Spark sent with it."""

    def look(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.column(0).buffers()[2].size])], ["n", "size"])

    return _common.map_texts(df, look, "n long, size long")


def test_spark_sends_texts_in_small_batches(spark):
    """By rows and by bytes, also where the frame is run by others later on."""
    short = _seen(spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("ab"), 10).alias("t"))).select("n", "size").collect()
    assert sum(r["n"] for r in short) == 3000 and max(r["n"] for r in short) <= 500
    long = _seen(spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))).collect()
    assert sum(r["n"] for r in long) == 400 and max(r["size"] for r in long) < 10_000_000


def test_small_batches_leave_the_rest_to_the_session(spark):
    rows, parts = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"
    df, had = spark.range(0, 3000, 1, 1).select(F.lit("a").alias("t")), spark.conf.get(parts)
    try:
        for n in ("3", "5"):
            spark.conf.set(parts, n)
            assert _seen(df).sparkSession.conf.get(parts) == n
        spark.conf.set(rows, "700")  # what a session sets itself holds
        assert max(r["n"] for r in _seen(df).collect()) == 700
    finally:
        spark.conf.unset(rows)
        spark.conf.set(parts, had)
    assert max(r["n"] for r in _seen(df).collect()) <= 500
    assert _common.written(_seen(df), "seen").sparkSession is spark and not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("texts_")]
    assert _seen(_seen(df).select(F.col("n").cast("string").alias("t"))).count()


def test_workers_give_back_what_they_have_free(monkeypatch):
    """At the end of a task, and of one that its reader leaves early."""

    class Frame:
        def mapInArrow(self, run, schema):
            return run

    seen = []
    monkeypatch.setattr(_common, "give_back", lambda: seen.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, "b"])], ["t"])
    run = _common.map_texts(Frame(), lambda batches: batches, "t string")
    assert [b.num_rows for b in run([batch, batch])] == [3, 3] and len(seen) == 1
    left = run([batch, batch])
    next(left)
    left.close()
    assert len(seen) == 2


def test_giving_back_frees_memory():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) / 1024

    kept = [bytes(1000) for _ in range(200_000)]
    kept = kept[::1000]  # what stays keeps the allocator from shrinking its end
    before = held()
    _common.give_back()
    assert held() < before - 50 and len(kept) == 200


def test_frames_of_the_driver_need_no_workers(spark):
    df = _common.local_frame(spark, at=pa.array([3, -(2**63), 2**63 - 1], pa.int64()), toxic=pa.array([True, False, None], pa.bool_()))
    assert sorted(map(tuple, df.collect())) == [(-(2**63), False), (3, True), (2**63 - 1, None)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan


def test_counts_while_writing(spark):
    df, n = _common.counted(spark.range(100), "numbers", F.col("id") % 3 == 0)
    assert n == 34 and df.count() == 100
    assert _common.counted(spark.range(5).where("id > 9"), "numbers")[1] == 0


def test_what_passes_is_removed(spark):
    def there(path):
        return os.path.exists(path.removeprefix("file://"))

    with scratch.passing() as kept:
        some = [scratch.shared_path(spark, "some") for _ in range(2)]
        for path in some:
            spark.range(1).write.parquet(path)
        kept.add(some[0])
    assert there(some[0]) and not there(some[1])
    scratch.drop_path(some[0])
    assert not there(some[0])
