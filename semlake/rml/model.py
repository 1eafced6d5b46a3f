"""Triples maps: how a logical source's rows become triples."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .turtle import by_subject, read_turtle

RR = "http://www.w3.org/ns/r2rml#"
RML = "http://semweb.mmlab.be/ns/rml#"


@dataclass(frozen=True)
class LogicalSource:
    """Where rows come from: a source's name, and what of it (table, query or iterator)."""

    source: str
    table: str | None = None
    query: str | None = None
    iterator: str | None = None
    formulation: str | None = None


@dataclass(frozen=True)
class TermMap:
    """A term for each row.

    ``how``: template (IRI pieces around columns), reference (a column) or constant.
    ``kind``: iri, literal or bnode.
    """

    how: str
    value: str
    kind: str
    datatype: str | None = None
    lang: str | None = None
    classes: tuple[str, ...] = ()

    def pieces(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Constant pieces, and the columns between them: one fewer."""
        if self.how == "constant":
            return (self.value,), ()
        if self.how == "reference":
            return ("", ""), (self.value,)
        found = re.split(r"(?<!\\)\{(.+?)(?<!\\)\}", self.value)
        return tuple(p.replace("\\{", "{").replace("\\}", "}") for p in found[::2]), tuple(found[1::2])


@dataclass(frozen=True)
class Join:
    child: str
    parent: str


@dataclass(frozen=True)
class ObjectMap:
    """A term map, or the subject of another triples map (``parent``, by name) under join conditions."""

    term: TermMap | None = None
    parent: str | None = None
    joins: tuple[Join, ...] = ()


@dataclass(frozen=True)
class PredicateObject:
    predicate: str
    object: ObjectMap


@dataclass
class TriplesMap:
    """``unique``: the subject's columns identify a row, so maps of the same table may share a scan.

    ``strict``: repeated triples of the source are one triple, as in an RDF graph.
    """

    name: str
    source: LogicalSource
    subject: TermMap
    classes: tuple[str, ...] = ()
    objects: list[PredicateObject] = field(default_factory=list)
    unique: bool = False
    strict: bool = False
    #: The catalog's source, where the logical source does not name it.
    owner: str | None = None

    def predicates(self) -> list[str]:
        return list(dict.fromkeys(po.predicate for po in self.objects))


def ref(column: str, datatype: str | None = None, lang: str | None = None) -> ObjectMap:
    """A literal from a column."""
    return ObjectMap(TermMap("reference", column, "literal", datatype, lang))


def iri_map(template: str, kind: str = "iri", classes: tuple[str, ...] = ()) -> ObjectMap:
    """An IRI from a template."""
    return ObjectMap(TermMap("template" if "{" in template else "constant", template, kind, classes=classes))


def _one(node: dict, *names: str) -> str | None:
    for name in names:
        for o in node.get(name, ()):
            return o[1]
    return None


def _term_map(node: dict, default: str) -> TermMap:
    """The term map that a Turtle node describes; ``default`` is the kind of constants."""
    kinds = {RR + "IRI": "iri", RR + "Literal": "literal", RR + "BlankNode": "bnode", RR + "BNode": "bnode"}
    said = kinds.get(_one(node, RR + "termType") or "")
    datatype, lang = _one(node, RR + "datatype"), _one(node, RR + "language")
    classes = tuple(o[1] for o in node.get(RR + "class", ()))
    if (v := _one(node, RR + "template")) is not None:
        return TermMap("template", v, said or "iri", datatype, lang, classes)
    if (v := _one(node, RML + "reference", RR + "column")) is not None:
        return TermMap("reference", v, said or "literal", datatype, lang, classes)
    for o in node.get(RR + "constant", ()):
        kind = said or ("iri" if o[0] == "uri" else "literal" if o[0] == "literal" else default)
        return TermMap("constant", o[1], kind, datatype or o[2], lang or o[3], classes)
    raise ValueError("a term map needs a template, a reference or a constant")


def load_rml(text: str, base: str = "") -> list[TriplesMap]:
    """The triples maps of a Turtle document.

    A subject without class has the triples map's IRI as its class. Predicates
    must be constant; several predicate or object maps of one
    predicate-object map combine.
    """
    nodes = by_subject(read_turtle(text, base))
    out = []
    for name, node in nodes.items():
        if RML + "logicalSource" not in node and RR + "logicalTable" not in node:
            continue
        logical = nodes.get(_one(node, RML + "logicalSource", RR + "logicalTable"), {})
        source = LogicalSource(
            _one(logical, RML + "source") or "", _one(logical, RR + "tableName"), _one(logical, RML + "query", RR + "sqlQuery"),
            _one(logical, RML + "iterator"), (_one(logical, RML + "referenceFormulation") or "").rpartition("#")[2] or None,
        )
        if (s := _one(node, RR + "subject")) is not None:
            subject = TermMap("constant", s, "iri")
        else:
            subject = _term_map(nodes[_one(node, RR + "subjectMap")], "iri")
            if subject.kind == "literal":
                subject = TermMap(subject.how, subject.value, "iri", classes=subject.classes)
        tm = TriplesMap(name, source, subject, subject.classes or (name,))
        for po in node.get(RR + "predicateObjectMap", ()):
            po = nodes[po[1]]
            predicates = [o[1] for o in po.get(RR + "predicate", ())]
            for pm in po.get(RR + "predicateMap", ()):
                t = _term_map(nodes[pm[1]], "iri")
                if t.how != "constant":
                    raise ValueError(f"{name}: predicates must be constant")
                predicates.append(t.value)
            objects = [ObjectMap(TermMap("constant", o[1], "iri" if o[0] == "uri" else "literal", o[2], o[3])) for o in po.get(RR + "object", ())]
            for om in po.get(RR + "objectMap", ()):
                om = nodes[om[1]]
                if (parent := _one(om, RR + "parentTriplesMap")) is not None:
                    joins = [nodes[j[1]] for j in om.get(RR + "joinCondition", ())]
                    objects.append(ObjectMap(parent=parent, joins=tuple(Join(_one(j, RR + "child"), _one(j, RR + "parent")) for j in joins)))
                else:
                    objects.append(ObjectMap(_term_map(om, "literal")))
            tm.objects += [PredicateObject(p, o) for p in predicates for o in objects]
        out.append(tm)
    return out
