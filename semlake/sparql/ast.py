"""Terms, expressions, graph patterns and query forms."""

from __future__ import annotations

from dataclasses import dataclass, field

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
XSD = "http://www.w3.org/2001/XMLSchema#"


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self):
        return "?" + self.name


@dataclass(frozen=True)
class Iri:
    value: str

    def __str__(self):
        return f"<{self.value}>"


@dataclass(frozen=True)
class Literal:
    """``value`` is a str, int, Decimal, float or bool; other datatypes keep their text."""

    value: object
    datatype: str | None = None
    lang: str | None = None

    def __str__(self):
        if self.datatype is None and not isinstance(self.value, str):
            return str(self.value).lower()
        quoted = '"' + str(self.value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
        return quoted + (f"@{self.lang}" if self.lang else f"^^<{self.datatype}>" if self.datatype else "")


Node = Var | Iri | Literal


@dataclass(frozen=True)
class Call:
    """An operator or function: name in upper case (operators as written), or an IRI."""

    name: str
    args: tuple

    def __str__(self):
        return f"{self.name}({', '.join(map(str, self.args))})"


Expr = Var | Iri | Literal | Call


@dataclass(frozen=True)
class Triple:
    s: Node
    p: Node
    o: Node

    def vars(self) -> list[str]:
        return [x.name for x in (self.s, self.p, self.o) if isinstance(x, Var)]

    def __str__(self):
        return f"{self.s} {self.p} {self.o} ."


@dataclass
class Group:
    """``{ ... }``: elements in the order they are written."""

    parts: list = field(default_factory=list)


@dataclass
class Optional_:
    group: Group


@dataclass
class Union_:
    branches: list[Group]


@dataclass
class Filter_:
    expr: Expr


@dataclass(frozen=True)
class OrderKey:
    expr: Expr
    descending: bool = False


@dataclass
class QuerySpec:
    form: str  # SELECT, ASK or CONSTRUCT
    where: Group
    variables: list[str] | None = None  # None: *
    distinct: bool = False
    order: list[OrderKey] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    template: list[Triple] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)


def expr_vars(expr) -> set[str]:
    if isinstance(expr, Var):
        return {expr.name}
    if isinstance(expr, Call):
        return set().union(*(expr_vars(a) for a in expr.args)) if expr.args else set()
    return set()
