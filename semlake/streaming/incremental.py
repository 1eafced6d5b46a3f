"""Answers one by one, partition by partition, with the time of each."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row


@dataclass
class Trace:
    """Seconds from the start to each answer (``keep``), to the first, and to the end; and how many there are."""

    started: float = field(default_factory=time.perf_counter)
    times: list[float] = field(default_factory=list)
    total: float | None = None
    keep: bool = True
    first: float | None = None
    count: int = 0

    def answer(self) -> None:
        now = time.perf_counter() - self.started
        self.count += 1
        if self.first is None:
            self.first = now
        if self.keep:
            self.times.append(now)

    def end(self) -> None:
        self.total = time.perf_counter() - self.started


def answers(df: DataFrame, trace: Trace | None = None) -> Iterator[Row]:
    """Rows as their partitions finish; only one partition at a time is held (and the next fetched)."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        if trace is not None:
            trace.answer()
        yield row
    if trace is not None:
        trace.end()
