"""Where rows come from: formats, nested paths, triple tables, property graphs."""

from .paths import reach
from .registry import FORMATS, SourceSpec, load, register_format

__all__ = ["FORMATS", "SourceSpec", "load", "reach", "register_format"]
