"""Algebra to lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Compiler, FunctionRegistry, registry
from ..operators import solutions as S
from ..sparql.ast import RDF_TYPE, XSD, Filter_, Group, Iri, Optional_, OrderKey, QuerySpec, Triple, Union_, Var, expr_vars
from ..sparql.parser import pattern_vars
from . import algebra as A
from . import stars as stars_
from . import terms as T
from .catalog import Catalog


class PatternCompiler:
    """Compiles patterns over a catalog; ``trace`` gets a line for each star."""

    def __init__(self, spark: SparkSession, catalog: Catalog, functions: FunctionRegistry = registry, loaded: dict | None = None):
        self.spark, self.functions = spark, functions
        self.planner = stars_.Planner(spark, catalog, loaded)
        self.trace: list[str] = []

    def pattern(self, node) -> S.Solutions:
        if isinstance(node, A.BGP):
            return self.bgp(node)
        if isinstance(node, A.Unit):
            return S.unit(self.spark)
        if isinstance(node, A.Join):
            return S.join(self.pattern(node.left), self.pattern(node.right))
        if isinstance(node, A.LeftJoin):
            left, right = self.pattern(node.left), self.pattern(node.right)
            used = set().union(*map(expr_vars, node.exprs)) if node.exprs else set()
            return S.left_join(left, right, lambda terms: self.conditions(node.exprs, terms), used)
        if isinstance(node, A.Union):
            return S.union([self.pattern(b) for b in node.branches])
        if isinstance(node, A.Filter):
            s = self.bgp(node.child, tuple(node.exprs)) if isinstance(node.child, A.BGP) else self.pattern(node.child)
            return S.Solutions(s.df.where(self.conditions(node.exprs, s.terms)), s.terms)
        raise TypeError(node)

    def classes(self, q: QuerySpec) -> S.Solutions | None:
        """``SELECT DISTINCT ?c { ?s a ?c }`` asks only which classes have a subject at all."""
        parts = q.where.parts
        if not (q.form == "SELECT" and q.distinct and len(parts) == 1 and isinstance(parts[0], Triple)):
            return None
        t = parts[0]
        plain = isinstance(t.s, Var) and t.p == Iri(RDF_TYPE) and isinstance(t.o, Var) and t.s != t.o
        if not plain or q.variables != [t.o.name]:
            return None
        found = self.planner.class_list(t.o.name)
        if found is None:
            return None
        self.trace.append(f"classes of {len(found.names)} maps, one row of each")
        return S.Solutions(found.make(), found.terms)

    def conditions(self, exprs, terms) -> Column | None:
        out = None
        for e in exprs:
            c = Compiler(terms, self.functions).condition(e)
            out = c if out is None else out & c
        return out

    def bgp(self, node: A.BGP, filters: tuple = ()) -> S.Solutions:
        self.planner.filters = filters
        stars = [self.planner.star(ts) for ts in A.stars(node.triples)]
        before = [len(s.alternatives) for s in stars]
        stars_.prune(stars)
        stars = stars_.merge_remote(stars, self.planner)
        stars = stars_.ordered(stars, lambda star: stars_.estimated_bytes(star, self.planner))
        for s in stars:
            self.trace.append(f"star of {s.triples[0].s}: {len(s.triples)} triples over {' | '.join('+'.join(a.names) for a in s.alternatives) or 'nothing'}")
        self.trace.append(f"{sum(before)} alternatives, {sum(len(s.alternatives) for s in stars)} after pruning")
        names = list(dict.fromkeys(v for t in node.triples for v in t.vars()))
        if not all(s.alternatives for s in stars):
            return S.nothing(self.spark, names)
        out = None
        for star in stars:
            remote = star.alternatives[0].remote if len(star.alternatives) == 1 else None
            bound = self.planner.bind(remote, out.terms, out.df) if remote is not None and out is not None else None
            if bound is not None:
                self.trace.append(f"{remote.source.name} is asked for the keys that the other stars bring")
                star.alternatives = [bound]
            one = S.union([S.Solutions(a.frame(), a.terms) for a in star.alternatives])
            out = one if out is None else S.join(out, one)
        self.planner.filters = ()
        return out


def _uses(q: QuerySpec, names: list[str]) -> tuple[frozenset[str], dict[str, int]] | None:
    """The variables that a query shows, filters or sorts by, and in how many places of triples each variable stands; None where all count."""
    if q.form != "SELECT":
        return None
    counts: dict[str, int] = {}
    kept = set(names).union(*(expr_vars(k.expr) for k in q.order))

    def walk(part) -> None:
        if isinstance(part, Triple):
            for v in part.vars():
                counts[v] = counts.get(v, 0) + 1
        elif isinstance(part, Group):
            for p in part.parts:
                walk(p)
        elif isinstance(part, Optional_):
            walk(part.group)
        elif isinstance(part, Union_):
            for b in part.branches:
                walk(b)
        elif isinstance(part, Filter_):
            kept.update(expr_vars(part.expr))

    walk(q.where)
    return frozenset(kept), counts


def order_columns(keys: list[OrderKey], terms: dict[str, T.Term], functions: FunctionRegistry) -> list[Column]:
    """Sort keys: unbound, then blank nodes, then IRIs, then literals; numbers before other literals where kinds mix."""
    out = []
    for k in keys:
        c = Compiler(terms, functions)
        v = c.val(k.expr)
        cols = [v.col]
        if v.kind == "mixed":
            kind, text = v.col.getField("kind"), v.col.getField("value")
            rank = F.when(kind == "bnode", 1).when(kind == "uri", 2).when(kind == "literal", 3)
            cols = [rank, F.when(kind == "literal", text.try_cast("double")), text]
        for i, x in enumerate(cols):
            low = i == 0 or v.kind != "mixed"
            if k.descending:
                out.append(x.desc_nulls_last() if low else x.desc_nulls_first())
            else:
                out.append(x.asc_nulls_first() if low else x.asc_nulls_last())
    return out


@dataclass
class Compiled:
    """A query's frame as it is shown, its variables, how it was planned, and the same rows as terms.

    ``typed`` has for each variable a struct (kind, value, datatype, lang) where rows differ in kind; for others
    ``kinds`` says what all their values are.
    """

    df: DataFrame
    names: list[str]
    trace: list[str]
    typed: DataFrame
    kinds: dict[str, tuple[str, str | None, str | None] | None]


def compile_query(spark: SparkSession, catalog: Catalog, q: QuerySpec, functions: FunctionRegistry = registry, loaded: dict | None = None) -> Compiled:
    compiler = PatternCompiler(spark, catalog, functions, loaded)
    names = q.variables if q.variables is not None else pattern_vars(q.where)
    compiler.planner.uses, compiler.planner.distinct = _uses(q, names), q.form == "SELECT" and q.distinct
    s = compiler.classes(q) or compiler.pattern(A.translate(q.where))
    if q.form == "ASK":
        df = s.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))
        return Compiled(df, ["result"], compiler.trace, df, {"result": ("literal", XSD + "boolean", None)})
    if q.form == "CONSTRUCT":
        s = _sliced(S.Solutions(s.df.orderBy(*order_columns(q.order, s.terms, functions)) if q.order else s.df, s.terms), q)
        return Compiled(S.construct(s, q.template, _shown), ["s", "p", "o"], compiler.trace, S.construct(s, q.template, _typed), {"s": None, "p": None, "o": None})
    if q.distinct:
        s = S.distinct(s, names)
    if q.order:
        s = S.Solutions(s.df.orderBy(*order_columns(q.order, s.terms, functions)), s.terms)
    s = _sliced(s, q)
    kinds = {v: None if (t := s.terms.get(v)) is None or t.kind == "mixed" else ("uri" if t.kind == "iri" else t.kind, t.xsd() if t.kind == "literal" else None, t.lang) for v in names}
    typed = s.df.select(*[(T.columns(s.terms[v])[0] if kinds[v] is None else T.value(s.terms[v])).alias(v) if v in s.terms else F.lit(None).cast(T.MIXED).alias(v) for v in names])
    return Compiled(S.shown(s, names), names, compiler.trace, typed, kinds)


def _sliced(s: S.Solutions, q: QuerySpec) -> S.Solutions:
    df = s.df
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return S.Solutions(df, s.terms)


def _shown(node, terms: dict[str, T.Term]) -> Column:
    if isinstance(node, Var):
        return T.value(terms[node.name]).cast("string") if node.name in terms else F.lit(None).cast("string")
    if isinstance(node, Iri):
        return F.lit(node.value)
    return F.lit(str(node.value).lower() if isinstance(node.value, bool) else str(node.value))


def _typed(node, terms: dict[str, T.Term]) -> Column:
    if isinstance(node, Var):
        return T.mixed(terms.get(node.name))
    if isinstance(node, Iri):
        said = ("uri", node.value, None, None)
    else:
        text = str(node.value).lower() if isinstance(node.value, bool) else str(node.value)
        kind = node.datatype or next((XSD + name for cls, name in ((bool, "boolean"), (int, "integer"), (Decimal, "decimal"), (float, "double")) if isinstance(node.value, cls)), None)
        said = ("literal", text, kind, node.lang)
    return F.struct(*[F.lit(x).cast("string").alias(n) for x, n in zip(said, ("kind", "value", "datatype", "lang"))])


__all__ = ["Compiled", "PatternCompiler", "compile_query", "order_columns"]
