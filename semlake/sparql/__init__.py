"""SPARQL text to syntax trees."""

from .ast import QuerySpec
from .parser import SparqlSyntaxError, parse

__all__ = ["QuerySpec", "SparqlSyntaxError", "parse"]
