"""How a variable is kept in columns, and how two of them are compared.

An IRI from a template stays its native key columns until it is shown, so that
constants and joins reach the source as key predicates. Literals keep their
Spark type. Only variables of mixed kinds become structs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sparql.ast import XSD

INTEGERS = ("tinyint", "smallint", "int", "bigint")
MIXED = "struct<kind:string,value:string,datatype:string,lang:string>"
_XSD_OF = {"string": "string", "boolean": "boolean", "tinyint": "byte", "smallint": "short", "int": "int", "bigint": "long", "float": "float", "double": "double", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "date": "date"}


@dataclass(frozen=True)
class Term:
    """A variable's columns.

    kind: iri, bnode, literal or mixed. ``pieces`` are a template's constant parts
    around ``cols`` (an IRI in one column has two empty pieces). ``certain``: never unbound.
    """

    kind: str
    cols: tuple[str, ...]
    types: tuple[str, ...]
    pieces: tuple[str, ...] = ()
    datatype: str | None = None
    lang: str | None = None
    certain: bool = True

    @property
    def injective(self) -> bool:
        """Equal values have equal columns: no blanks to rewrite, no IRIs that stand for themselves."""
        return self.kind != "mixed" and all(t in INTEGERS or t == "date" for t in self.types) and all(self.pieces[1:-1]) or self.plain and self.kind == "literal"

    @property
    def plain(self) -> bool:
        """The one column is the value itself."""
        return self.kind == "literal" or self.kind in ("iri", "bnode") and self.pieces == ("", "") and self.types == ("string",)

    def numeric(self) -> bool:
        return self.kind == "literal" and is_number(self.types[0])

    def xsd(self) -> str:
        """The datatype of a literal: as mapped, or that of its Spark type."""
        t = self.types[0]
        return self.datatype or XSD + ("decimal" if t.startswith("decimal") else _XSD_OF.get(t, "string"))


def is_number(kind: str) -> bool:
    return kind in INTEGERS or kind in ("float", "double") or kind.startswith("decimal")


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def columns(term: Term) -> list[Column]:
    return [column(c) for c in term.cols]


def bound(term: Term) -> Column:
    out = None
    for c in columns(term):
        out = c.isNotNull() if out is None else out & c.isNotNull()
    return out


def _key_text(c: Column, kind: str) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_")) if kind == "string" else c.cast("string")


def value(term: Term) -> Column:
    """What a result shows: an IRI's text, a literal in its own type, a mixed term's text."""
    cs = columns(term)
    if term.kind == "mixed":
        return cs[0].getField("value")
    if term.kind == "literal":
        return cs[0]
    if term.plain:
        return F.replace(cs[0], F.lit(" "), F.lit("_"))
    parts = []
    for piece, c, t in zip(term.pieces, cs, term.types):
        if piece:
            parts.append(F.lit(piece))
        parts.append(_key_text(c, t))
    if term.pieces[-1]:
        parts.append(F.lit(term.pieces[-1]))
    built = F.concat(*parts)
    if len(cs) == 1 and term.types[0] == "string":  # a value that is an IRI already stays as it is
        return F.when(F.contains(cs[0], F.lit("http://")), F.replace(cs[0], F.lit(" "), F.lit("_"))).otherwise(built)
    return built


def mixed(term: Term | None) -> Column:
    """As a struct; null if unbound."""
    if term is None:
        return F.lit(None).cast(MIXED)
    if term.kind == "mixed":
        return columns(term)[0]
    if term.kind == "literal":
        datatype = None if term.lang or term.xsd() == XSD + "string" else term.xsd()
        made = F.struct(F.lit("literal").alias("kind"), columns(term)[0].cast("string").alias("value"), F.lit(datatype).cast("string").alias("datatype"), F.lit(term.lang).cast("string").alias("lang"))
    else:
        made = F.struct(F.lit("uri" if term.kind == "iri" else "bnode").alias("kind"), value(term).alias("value"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    return F.when(bound(term), made)


def prefix_of(term: Term) -> str:
    return term.pieces[0] if term.pieces else ""


def disjoint(a: Term, b: Term) -> bool:
    """No term can be of both, by kind or by the constant parts of their templates."""
    if "mixed" in (a.kind, b.kind):
        return False
    if a.kind != b.kind:
        return True
    if a.kind == "literal":
        return False
    if any(_bypasses(t) for t in (a, b)):
        return False
    p, q = a.pieces[0], b.pieces[0]
    if not (p.startswith(q) or q.startswith(p)):
        return True
    p, q = a.pieces[-1], b.pieces[-1]
    if not (p.endswith(q) or q.endswith(p)):
        return True
    # numbers only, so what follows the shorter prefix must be digits
    for x, y in ((a, b), (b, a)):
        if len(x.cols) == 1 and x.types[0] in INTEGERS and y.pieces[0].startswith(x.pieces[0]):
            rest = y.pieces[0][len(x.pieces[0]) :]
            if rest and not re.fullmatch(r"-?\d*", rest):
                return True
    return False


def _bypasses(term: Term) -> bool:
    """Its values may be IRIs outside of the template."""
    return len(term.cols) == 1 and term.types[0] == "string"


def equal_keys(a: Term, b: Term) -> list[tuple[Column, Column]] | None:
    """Pairs (of a, of b) of expressions that are equal exactly if two bound terms are the same; None if they never are."""
    if disjoint(a, b):
        return None
    if "mixed" in (a.kind, b.kind):
        if a.kind != "mixed":
            return [(y, x) for x, y in equal_keys(b, a)]
        x = columns(a)[0]
        kind, text = x.getField("kind"), x.getField("value")
        if b.kind == "mixed":
            y = columns(b)[0]
            none = F.lit("")
            return [(text, y.getField("value")), (kind, y.getField("kind")), *((F.coalesce(x.getField(f), none), F.coalesce(y.getField(f), none)) for f in ("datatype", "lang"))]
        if b.kind == "literal":
            same = (text.try_cast("double"), columns(b)[0].cast("double")) if b.numeric() else (text, columns(b)[0].cast("string"))
            return [same, (kind, F.lit("literal"))]
        return [(text, value(b)), (kind, F.lit("uri" if b.kind == "iri" else "bnode"))]
    if a.kind == "literal":
        x, y, s, t = columns(a)[0], columns(b)[0], a.types[0], b.types[0]
        if s == t or a.numeric() and b.numeric():
            return [(x, y)]
        if "string" in (s, t) and (a.numeric() or b.numeric()):
            return [(x.try_cast("double"), y.cast("double")) if s == "string" else (x.cast("double"), y.try_cast("double"))]
        return [(x.cast("string"), y.cast("string"))]
    if a.pieces == b.pieces and a.injective and b.injective:
        return list(zip(columns(a), columns(b)))
    return [(value(a), value(b))]


def equal(a: Term, b: Term) -> Column | None:
    """A condition that two bound terms are the same; None if they never are."""
    pairs = equal_keys(a, b)
    if pairs is None:
        return None
    out = None
    for x, y in pairs:
        out = x == y if out is None else out & (x == y)
    return out


def keys_of(term: Term, iri: str) -> tuple[str, ...] | None:
    """The texts that stand for the template's columns in this IRI; None if it does not fit."""
    pattern = "".join(re.escape(p) + ("(.+?)" if i < len(term.pieces) - 2 else "(.+)" if i < len(term.pieces) - 1 else "") for i, p in enumerate(term.pieces))
    m = re.fullmatch(pattern, iri)
    return m.groups() if m else None


def is_iri(term: Term, iri: str) -> Column | None:
    """A condition that a bound term is this IRI, on key columns where possible; None if it never is."""
    if term.kind == "mixed":
        x = columns(term)[0]
        return (x.getField("value") == iri) & (x.getField("kind") == "uri")
    if term.kind != "iri":
        return None
    if term.plain:
        return columns(term)[0] == iri if "_" not in iri else value(term) == iri
    found = keys_of(term, iri)
    own = None
    if found is not None:
        own = F.lit(True)
        first = True
        for c, t, key in zip(columns(term), term.types, found):
            if t in INTEGERS:
                if not re.fullmatch(r"0|-?[1-9]\d{0,18}", key) or abs(int(key)) > {"tinyint": 127, "smallint": 32767, "int": 2**31 - 1, "bigint": 2**63 - 1}[t]:
                    own = None
                    break
                one = c == F.lit(int(key)).cast(t)
            elif t == "string" and "_" not in key:
                one = c == key
            else:
                one = _key_text(c, t) == key
            own, first = one if first else own & one, False
        if own is not None and len(term.cols) > 1 and "string" in term.types:
            own = value(term) == iri  # where a text key ends is not certain
    if _bypasses(term) and "http://" in iri:
        itself = columns(term)[0] == iri
        return itself if own is None else own | itself
    return own


def is_literal(term: Term, lit) -> Column | None:
    """A condition that a bound term is this literal; a language is compared only where the query names one."""
    v = lit.value
    if term.kind == "mixed":
        x = columns(term)[0]
        text = x.getField("value")
        same = text.try_cast("double") == float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else text == (str(v).lower() if isinstance(v, bool) else str(v))
        same = same & (x.getField("kind") == "literal")
        return same & (F.lower(x.getField("lang")) == lit.lang) if lit.lang else same
    if term.kind != "literal" or lit.lang and term.lang and lit.lang != term.lang:
        return None
    c, t = columns(term)[0], term.types[0]
    if isinstance(v, bool):
        return c == v if t == "boolean" else c.cast("string") == str(v).lower()
    if isinstance(v, str):
        if t == "string":
            return c == v
        return c == F.lit(v).try_cast(t)
    if is_number(t):
        return c == F.lit(v)
    return c.try_cast("double") == F.lit(float(v)) if t == "string" else None


def unified(terms: list[Term | None]) -> Term:
    """A form (without column names) that all of these fit; None stands for unbound."""
    have = [t for t in terms if t is not None]
    certain = len(have) == len(terms) and all(t.certain for t in have)
    first = have[0]
    if all(t.kind == first.kind for t in have) and first.kind != "mixed":
        if all((t.pieces, t.types, t.datatype, t.lang) == (first.pieces, first.types, first.datatype, first.lang) for t in have):
            return replace(first, cols=(), certain=certain)
        if first.kind != "literal":
            if all(t.pieces == first.pieces and t.injective for t in have) and all(x in INTEGERS for t in have for x in t.types):
                return replace(first, cols=(), types=("bigint",) * len(first.cols), certain=certain)
            return Term(first.kind, (), ("string",), ("", ""), certain=certain)
        if all(t.numeric() for t in have) and all(not t.datatype for t in have):
            kinds = {t.types[0] for t in have}
            kind = kinds.pop() if len(kinds) == 1 else "bigint" if kinds <= set(INTEGERS) else "double"
            return Term("literal", (), (kind,), certain=certain)
        if all(t.types == first.types and t.lang == first.lang for t in have):
            return Term("literal", (), first.types, lang=first.lang, certain=certain)
    return Term("mixed", (), (MIXED,), certain=certain)


def fitted(term: Term | None, form: Term) -> list[Column]:
    """The columns of a term in another form."""
    if term is None:
        return [F.lit(None).cast(t) for t in form.types]
    if form.kind == "mixed":
        return [mixed(term)]
    if form.kind in ("iri", "bnode") and form.pieces == ("", "") and form.types == ("string",):
        return [value(term)]
    return [c.cast(t) if t != u else c for c, t, u in zip(columns(term), form.types, term.types)]
