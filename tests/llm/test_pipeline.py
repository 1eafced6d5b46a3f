"""Each stage on its own input, against the operators' plain meaning."""

import pytest

import corpus_pipeline
from semlake.llm import decontaminate, line_dedup, pieces, simhash
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, kept[-1], SF).write.parquet(path)
        kept.append(spark.read.parquet(path))
    return kept


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1]) and len(corpus_pipeline.STAGES) == 5


def test_quality_keeps_the_clean(stages, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages[1].join(labels, "doc_id")
    clean = labels.where("quality = 1 and toxic = 0").count()
    assert kept.where("quality = 1 and toxic = 0").count() >= 0.99 * clean
    assert kept.where("quality = 0").count() <= 0.05 * labels.where("quality = 0").count()


def test_lines(stages, duck, spark, tmp_path):
    import os

    for t in ("documents",):
        stages[1].coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    for f in os.listdir(tmp_path / "documents.parquet"):
        if not f.endswith(".parquet"):
            os.remove(tmp_path / "documents.parquet" / f)
    want = duck(line_dedup.OP10_SQL, str(tmp_path))
    assert {(r.doc_id, r.text) for r in stages[2].collect()} == set(zip(want.doc_id, want.text))
    assert stages[2].where("n_chars <> length(text)").count() == 0


def test_near_copies(stages, spark):
    """The stage's rule is a five-word Jaccard similarity of 0.8. The rule of fingerprints within radius two is ``simhash.keep_one``'s."""
    texts = {r.doc_id: r.text for r in stages[2].collect()}
    ids = sorted(texts)
    kept = plain_kept([texts[i] for i in ids])
    assert {r.doc_id for r in stages[3].collect()} == {ids[i] for i in kept}
    components = plain_components({i: plain_fingerprint(t) for i, t in texts.items()})
    assert {r.doc_id for r in simhash.keep_one(stages[2]).collect()} == set(components.values())


def test_leaks(stages, duck, spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.contamination(stages[3], bench).where("n_items > 0").collect()}
    assert hit and {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()} - hit


def test_samples(stages):
    back = pieces.decode(stages[5], out_col="spelled").join(stages[4].select("doc_id", "text"), "doc_id")
    assert back.where("spelled <> text").count() == 0
    assert stages[5].select("doc_id").distinct().count() == stages[4].count()


