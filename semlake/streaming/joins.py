"""A symmetric hash join of two streams with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, within: str = "1 hour", late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Pairs of equal keys whose times are at most ``within`` apart; each side's state is dropped once it can match no more.

    The time columns must have different names. Works on batch frames as well.
    """
    a = left.withWatermark(left_time, late).alias("l")
    b = right.withWatermark(right_time, late).alias("r")
    condition = F.expr(f"r.`{right_time}` between l.`{left_time}` - interval {within} and l.`{left_time}` + interval {within}")
    for k in on:
        condition = condition & (F.col(f"l.`{k}`") == F.col(f"r.`{k}`"))
    keep = [F.col(f"r.`{c}`") for c in right.columns if c not in on]
    return a.join(b, condition, how).select("l.*", *keep)
