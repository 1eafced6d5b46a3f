"""Document stores and property graphs in the shapes that mappings can read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import quoted


def grouped(df: DataFrame, key: str, value: str, out: str = "values") -> DataFrame:
    """One document for each key, with the set of its values, as document stores keep repeated predicates."""
    return df.groupBy(quoted(key)).agg(F.collect_set(quoted(value)).alias(out))


def having_all(df: DataFrame, key: str, value: str, wanted: list) -> DataFrame:
    """Keys that have every one of the wanted values."""
    found = df.where(quoted(value).isin(*wanted)).select(quoted(key), quoted(value)).distinct()
    return found.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(wanted))).drop("n")


def hop(nodes: DataFrame, edges: DataFrame, start: str | None, relation: str | None, end: str | None) -> DataFrame:
    """(n, o): pairs of nodes (as structs) with an edge of this type between them; None: any label or type.

    ``nodes`` has id and label, ``edges`` has src, type and dst.
    """
    n = nodes.where(F.col("label") == start) if start else nodes
    o = nodes.where(F.col("label") == end) if end else nodes
    e = edges.where(F.col("type") == relation) if relation else edges
    left = n.select(F.struct(*[quoted(c) for c in n.columns]).alias("n"))
    right = o.select(F.struct(*[quoted(c) for c in o.columns]).alias("o"))
    return left.join(e, F.col("n.id") == F.col("src")).join(right, F.col("o.id") == F.col("dst")).select("n", "o")


def collected(df: DataFrame, key: str, value: str, out: str = "values") -> DataFrame:
    """One row for each key with the list of its values, duplicates kept."""
    return df.groupBy(quoted(key)).agg(F.collect_list(quoted(value)).alias(out))
