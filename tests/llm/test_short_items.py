"""Benchmark items of fewer words than a window, in the pipeline's stage."""

import corpus_pipeline
from semlake.llm import decontaminate

ITEMS = [("a", "The"), ("b", "good day"), ("c", "one two three four five six seven eight nine"), ("d", "red blue green")]
TEXTS = ["the house", "a good day", "the good day", "the one two three four five six seven", "x one two three four five six seven eight", "good day red blue green", "red blue"]


def test_one_short_item_is_no_leak(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)).collect()} == {0, 1, 3, 6}
    assert {r.doc_id: r.n_items for r in decontaminate.contamination(docs, items).collect()} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1, 5: 2, 6: 0}
