"""From raw documents to sampled token sequences, in five stages.

Each stage takes all that the stage before kept, and all but the last return
the columns of ``documents``. Stages are written between each other, so each
reads a table; what a stage wrote on its way goes once it is done.

In all stages null texts are empty texts, texts are taken whole whatever their length, no rows give no rows, and columns
besides ``doc_id`` and ``text`` pass through under their names but for ``n_chars`` after line dedup. Null ids and rows that
repeat an id are documents like any other; how a stage treats rows that repeat id and text is stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.llm import decontaminate, line_dedup, near_copies, pieces, quality
from semlake.llm._common import table
from semlake.scratch import drop_path, passing, shared_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for junk or toxic go; texts without words stay. Repeated rows go or stay together."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three lines in a row go; ``n_chars`` follows the text (null for null). Repeated rows get the same text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group linked by a five-word Jaccard similarity of 0.8 at least.

    Null ids come after all others; exactly one row of each group stays, so repeated rows become one, as do all texts without words.
    """
    return near_copies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with eight words in a row of any benchmark item go, or with the whole of two items of which some are shorter. Repeated rows go or stay together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), at_least_short=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, best key first, as piece ids; repeated rows each have the same ones."""
    return pieces.sample(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", remove_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("piece sampling", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        with passing() as kept:
            path = shared_path(spark, f"stage-{i}")
            kept.add(path)
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            drop_path(before)
        docs, before = spark.read.parquet(path), path
    return docs


#: Training a classifier and sampling by hash have no SQL; the stages are tested one by one instead.
ORACLE_SQL = None
