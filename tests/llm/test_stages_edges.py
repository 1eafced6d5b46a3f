"""Each stage of the pipeline on nulls, empty and long texts, repeated rows, no rows, and other columns of clashing names."""

from collections import Counter

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(f"w{i % 7919}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, "a b c\nd e f\ng h i\nj"), (3, "a b c\nd e f\ng h i\nj"), (None, " ".join(WORDS)), (None, " ".join(WORDS)), (4, " ".join(WORDS[:59])), (5, LONG), (6, "漢字 ê  \U0001F600")]
EXTRA = "lang string, source string, n_chars long, k1 string, a string, sig string, `row` string, `x.y` string, root string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", "s", 0, *["z"] * 6) for r in ROWS], "doc_id long, text string, " + EXTRA).repartition(3)


@pytest.mark.parametrize("at", range(4))
def test_columns_and_no_rows(spark, docs, at):
    stage = corpus_pipeline.STAGES[at][1]
    assert stage(spark, docs, SF).columns == docs.columns
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == docs.columns


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_quality(spark, docs):
    out = kept(corpus_pipeline.quality_filter(spark, docs, SF))
    assert out[1, None] == out[2, ""] == 1 and out[3, ROWS[2][1]] in (0, 2) and out[None, ROWS[4][1]] in (0, 2)


def test_lines(spark, docs):
    out = corpus_pipeline.remove_repeated_lines(spark, docs, SF)
    assert kept(out) == Counter(ROWS)
    assert {(r.doc_id, r.n_chars) for r in out.where("doc_id < 3").collect()} == {(1, None), (2, 0)}


def test_near_copies(spark, docs):
    # 55 of 56 shingles of one are the other's; null, empty: one group; repeated rows: one
    assert kept(corpus_pipeline.drop_near_copies(spark, docs, SF)) == Counter([(1, None), ROWS[2], ROWS[6], ROWS[7], ROWS[8]])


def test_leaks(spark, docs, tmp_path):
    spark.createDataFrame([(1, "A b, c d e f g h"), (None, "w0 w1 w2 w3 w4 w5 w6 w7"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = kept(corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)))
    assert out == Counter([r for r in ROWS if r[0] != 3])


def test_samples(spark, docs):
    from semlake.llm import pieces

    out = corpus_pipeline.encode(spark, docs, SF)
    assert {(r.doc_id, r.text) for r in pieces.decode(out).collect()} == {(i, t or "") for i, t in ROWS}
    assert corpus_pipeline.encode(spark, docs.limit(0), SF).count() == 0


def test_whole_run_is_the_stages_one_after_another(spark):
    want = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        want = spark.createDataFrame(stage(spark, want, SF).collect(), stage(spark, want, SF).schema)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == want.columns and Counter(map(str, got.collect())) == Counter(map(str, want.collect())) and got.count() > 0
