"""Expressions as Columns."""

from .expressions import Compiler, FunctionRegistry, registry

__all__ = ["Compiler", "FunctionRegistry", "registry"]
