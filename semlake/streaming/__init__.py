"""Results while they arrive, and joins of streams."""

from .incremental import Trace, answers
from .joins import stream_join

__all__ = ["Trace", "answers", "stream_join"]
