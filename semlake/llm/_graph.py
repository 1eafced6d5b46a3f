"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import counted, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every end of an edge (long, not null); equal roots mean connected.

    Each round points every vertex at its smallest neighbour, follows the
    pointers to their ends by steps that triple, and contracts the graph to those ends.
    A round at least halves what is still connected in all but contrived
    shapes, so rounds grow with the logarithm of the longest chain. All
    tables of a round are written, and hubs are left to skewed-join splitting:
    no vertex's neighbours meet in one task.
    """
    least, most = F.least(a, b), F.greatest(a, b)
    left, n = counted(edges.select(least.alias("a"), most.alias("b")).where("a <> b").distinct(), "edges")
    roots = None
    while n:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("root")), "pointers")
        moved = 1
        while moved:
            far = to.select(F.col("v").alias("root"), F.col("root").alias("next"))
            further = to.select(F.col("v").alias("next"), F.col("root").alias("last"))  # two steps in one table
            to, moved = counted(to.join(far, "root").join(further, "next").select("v", F.col("last").alias("root"), (F.col("last") != F.col("root")).alias("moved")), "pointers", F.col("moved"))
            to = to.drop("moved")
        if roots is None:
            roots = to
        else:
            further = to.select(F.col("v").alias("root"), F.col("root").alias("next"))
            roots = written(roots.join(further, "root", "left").select("v", F.coalesce("next", "root").alias("root")), "roots")
        ends = left
        for end in ("a", "b"):
            ends = ends.join(to.select(F.col("v").alias(end), F.col("root").alias("to_" + end)), end)
        left, n = counted(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct(), "edges")
    if roots is None:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots
