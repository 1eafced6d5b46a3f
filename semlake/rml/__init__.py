"""Mappings from rows to RDF terms, and the Turtle they are written in."""

from .model import Join, LogicalSource, ObjectMap, PredicateObject, TermMap, TriplesMap, iri_map, load_rml, ref
from .turtle import TurtleError, read_turtle

__all__ = ["Join", "LogicalSource", "ObjectMap", "PredicateObject", "TermMap", "TriplesMap", "TurtleError", "iri_map", "load_rml", "read_turtle", "ref"]
