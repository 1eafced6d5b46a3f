"""Stars: which sources answer the triples of one subject, and how they are scanned.

The triples of a subject are assigned to triples maps. Triples of one map share
a scan and are read row by row; several maps are joined on the subject. If
some map of a subject template offers everything, only such maps count;
otherwise maps of the same or a compatible template are combined. Each
assignment is an alternative, and the star is their union.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rml.model import LogicalSource, PredicateObject, TermMap, TriplesMap
from ..sources.paths import many, quoted, reach
from ..sources.registry import SourceSpec, load
from ..sources.remote import Remote, is_endpoint
from ..sparql.ast import RDF_TYPE, XSD, Iri, Literal, Triple, Var
from . import terms as T
from .catalog import Catalog

#: Assignments of one star beyond which each triple becomes a union of its own, joined with the others.
MOST = 64
#: What generated columns begin with; names that some source has are left out.
PREFIX = "~c"
_fresh = itertools.count()
_foreign: set[str] = set()
_CASTS = {"integer": "bigint", "long": "bigint", "int": "int", "short": "smallint", "byte": "tinyint", "decimal": "decimal(38,18)", "double": "double", "float": "float", "boolean": "boolean", "dateTime": "timestamp_ntz", "date": "date"}


class PlanError(ValueError):
    pass


def fresh() -> str:
    """A column name that no other column has, of whatever source."""
    while (name := f"{PREFIX}{next(_fresh)}") in _foreign:
        pass
    return name


class Scan:
    """One reading of a triples map's rows, with the columns and conditions asked of it.

    Columns are gathered and selected together, so that planning does not grow with them.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, tm: TriplesMap, df: DataFrame):
        self.spark, self.catalog, self.tm, self.df = spark, catalog, tm, df
        _foreign.update(c.lower() for c in df.columns if c.lower().startswith(PREFIX))
        self.kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        self.plain: list[Column] = []
        self.computed: list[Column] = []
        self.generated: list[Column] = []
        self.conditions: list[Column] = []
        self.needed: dict[str, str] = {}
        self.types: dict[str, str] = {}
        self.out: list[str] = []
        self.empty = False
        self.key: tuple = ()
        self.classes: set[str] = set(tm.classes)
        self.subject = self.term(tm.subject)
        self.guard(self.subject)

    def column(self, reference: str) -> str:
        if reference not in self.needed:
            name = fresh()
            if reference in self.kinds:
                self.plain.append(quoted(reference).alias(name))
                kind = self.kinds[reference]
            else:
                self.df, reached = reach(self.df, reference, name)
                kind = reached.simpleString()
            self.needed[reference], self.types[name] = name, kind
            self.out.append(name)
        return self.needed[reference]

    def made(self, c: Column, kind: str) -> str:
        """A column computed from those of this scan."""
        name = fresh()
        self.computed.append(c.alias(name))
        self.types[name] = kind
        self.out.append(name)
        return name

    def each(self, c: Column, kind: str) -> str:
        """A column with each element of an array, one row for each."""
        name = fresh()
        self.generated.append(F.explode(c).alias(name))
        self.types[name] = kind
        self.out.append(name)
        return name

    def iris(self, values: list[str]) -> T.Term:
        """A term that is each of these IRIs."""
        name = self.made(F.lit(values[0]), "string") if len(values) == 1 else self.each(F.array(*map(F.lit, values)), "string")
        return T.Term("iri", (name,), ("string",), ("", ""))

    def settle(self) -> None:
        """Puts the columns asked for so far into the frame."""
        for some in (self.plain, self.computed):
            if some:
                self.df = self.df.select("*", *some)
                some.clear()

    def term(self, tm: TermMap, rename=()) -> T.Term:
        """The term that a term map makes of this scan's rows."""
        renamed = dict(rename)
        if tm.how == "constant":
            if tm.kind == "literal":
                kind = _CASTS.get((tm.datatype or "").removeprefix(XSD), "string")
                return T.Term("literal", (self.made(F.lit(tm.value).try_cast(kind), kind),), (kind,), datatype=tm.datatype, lang=tm.lang)
            return T.Term(tm.kind, (self.made(F.lit(tm.value), "string"),), ("string",), ("", ""))
        pieces, references = tm.pieces()
        cols = tuple(self.column(renamed.get(r, r)) for r in references)
        types = tuple(self.types[c] for c in cols)
        if tm.kind == "literal" and tm.how == "template":
            parts = [x for p, c, t in zip(pieces, cols, types) for x in (F.lit(p), T.column(c).cast("string"))]
            return T.Term("literal", (self.made(F.concat(*parts, F.lit(pieces[-1])), "string"),), ("string",), datatype=tm.datatype, lang=tm.lang)
        if tm.kind == "literal":
            wanted = _CASTS.get((tm.datatype or "").removeprefix(XSD))
            if wanted and types[0] == "string":
                return T.Term("literal", (self.made(T.column(cols[0]).try_cast(wanted), wanted),), (wanted,), datatype=tm.datatype)
            return T.Term("literal", cols, types, datatype=tm.datatype if types[0] == "string" else None, lang=tm.lang)
        return T.Term(tm.kind, cols, types, pieces)

    def object(self, po: PredicateObject) -> T.Term | None:
        """The object's term; None if the parent's rows would need a join that finds nothing."""
        om = po.object
        if om.parent is None:
            t = self.term(om.term)
            self.guard(t)
            return t
        parent = self.catalog.maps.get(om.parent)
        if parent is None:
            raise PlanError(f"{self.tm.name}: no parent map {om.parent}")
        needed = parent.subject.pieces()[1]
        rename = {j.parent: j.child for j in om.joins}
        if set(needed) <= set(rename) or not om.joins:
            t = self.term(parent.subject, rename)
            self.guard(t)
            return t
        # the parent's template needs other columns of it: its rows are joined
        other = Scan(self.spark, self.catalog, parent, load(self.spark, self.catalog.source_of(parent), parent.source))
        on = None
        for j in om.joins:
            one = T.column(self.column(j.child)) == T.column(other.column(j.parent))
            on = one if on is None else on & one
        joined = other.frame()
        self.settle()
        self.df = self.df.join(joined, on)
        self.out += joined.columns
        self.types |= {c: other.types[c] for c in joined.columns}
        return other.subject

    def guard(self, term: T.Term) -> None:
        """A null, and an empty text in an IRI, makes no triple."""
        for c, t in zip(term.cols, term.types):
            self.conditions.append(T.column(c).isNotNull())
            if t == "string" and term.kind in ("iri", "bnode"):
                self.conditions.append(T.column(c) != "")

    def frame(self) -> DataFrame:
        self.settle()
        df = self.df
        for c in self.generated:
            df = df.select("*", c)
        on = None
        for c in self.conditions:
            on = c if on is None else on & c
        df = (df if on is None else df.where(on)).select(*[T.column(c) for c in dict.fromkeys(self.out)])
        return df.distinct() if self.tm.strict else df


@dataclass
class Alternative:
    """One way to answer a star: the variables' terms, and the frame once it is wanted."""

    terms: dict[str, T.Term]
    make: Callable[[], DataFrame]
    names: tuple[str, ...] = ()
    filters: int = 0
    made: DataFrame | None = None
    subject: T.Term | None = None
    #: What an endpoint answers as a whole, if it does.
    remote: object = None

    def frame(self) -> DataFrame:
        if self.made is None:
            self.made = self.make()
        return self.made


@dataclass
class Star:
    triples: list[Triple]
    alternatives: list[Alternative] = field(default_factory=list)

    def vars(self) -> set[str]:
        return {v for t in self.triples for v in t.vars()}


def _match(scan: Scan, term: T.Term, node, terms: dict[str, T.Term]) -> None:
    """Asks that the term be this node: binds a variable, or adds a condition."""
    if isinstance(node, Var):
        if node.name in terms:
            condition = T.equal(terms[node.name], term)
        else:
            terms[node.name] = term
            return
    elif isinstance(node, Iri):
        condition = T.is_iri(term, node.value)
    else:
        condition = T.is_literal(term, node)
    if condition is None:
        scan.empty = True
    else:
        scan.conditions.append(condition)


@dataclass(frozen=True)
class Offer:
    """A map that offers a triple: by a predicate-object map, (index None) by its classes, or by several of these (``ANY``)."""

    map: str
    index: int | None
    several: tuple[int | None, ...] = ()


ANY = -1


class Planner:
    """Finds the alternatives of stars in a catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog, loaded: dict | None = None):
        """``loaded`` keeps sources' frames, and which maps have rows, from one query to the next."""
        self.spark, self.catalog = spark, catalog
        self.loaded = {} if loaded is None else loaded
        #: What endpoints are told besides triples: conditions, the variables of use elsewhere (see ``compile``; None: all), whether repeated rows matter.
        self.filters: tuple = ()
        self.uses: tuple[frozenset[str], dict[str, int]] | None = None
        self.distinct = False

    def rows(self, source: SourceSpec, logical) -> DataFrame:
        key = (source.name, logical)
        if key not in self.loaded:
            self.loaded[key] = load(self.spark, source, logical)
        return self.loaded[key]

    def bytes_of(self, name: str) -> int:
        """The size of a map's table, or of a source of triples."""
        if ("bytes", name) not in self.loaded:
            tm = self.catalog.maps.get(name)
            source = self.catalog.source_of(tm) if tm else self.catalog.sources[name]
            if is_endpoint(source):
                return 1 << 40
            df = self.rows(source, tm.source if tm else LogicalSource(name))
            self.loaded["bytes", name] = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return self.loaded["bytes", name]

    def scan(self, name: str) -> Scan:
        tm = self.catalog.maps[name]
        return Scan(self.spark, self.catalog, tm, self.rows(self.catalog.source_of(tm), tm.source))

    def star(self, triples: list[Triple]) -> Star:
        star = Star(triples)
        s = triples[0].s
        groups: dict[str, list[str]] = {}
        for name, tm in self.catalog.maps.items():
            if tm.subject.kind == "bnode" and isinstance(s, Iri) or isinstance(s, Iri) and not _may_be(tm.subject, s.value):
                continue
            groups.setdefault((tm.subject.kind, "{}".join(tm.subject.pieces()[0])), []).append(name)
        for names in groups.values():
            star.alternatives += self.of_group(triples, names)
        for source in self.catalog.rdf_sources():
            offered = source.predicates
            if offered is None or all(not isinstance(t.p, Iri) or t.p.value in offered for t in triples):
                star.alternatives.append(self.of_triples(triples, source))
        if not star.alternatives:
            star.alternatives = self.across(triples)
        star.alternatives = [a for a in star.alternatives if a is not None]
        return star

    # maps of one subject template

    def offers(self, t: Triple, names: list[str]) -> list[Offer]:
        out = []
        for name in names:
            tm = self.catalog.maps[name]
            found: list[int | None] = []
            if isinstance(t.p, Var) or t.p.value == RDF_TYPE:
                if isinstance(t.o, Var) and tm.classes or isinstance(t.o, Iri) and t.o.value in tm.classes:
                    found.append(None)
            found += [i for i, po in enumerate(tm.objects) if (isinstance(t.p, Var) or po.predicate == t.p.value) and self.possible(po, t.o)]
            if isinstance(t.p, Var) and len(found) > 1:
                # all that one row tells: read once, and unfolded
                once = tuple(i for i in found if i is None or self.one_valued(tm, tm.objects[i]))
                if len(once) > 1:
                    out.append(Offer(name, ANY, once))
                    found = [i for i in found if i not in once]
            out += [Offer(name, i) for i in found]
        return out

    def one_valued(self, tm: TriplesMap, po: PredicateObject) -> bool:
        """A row has one value of this object at most, from its own columns."""
        if po.object.parent is not None:
            parent = self.catalog.maps.get(po.object.parent)
            return parent is not None and (not po.object.joins or set(parent.subject.pieces()[1]) <= {j.parent for j in po.object.joins})
        df = self.rows(self.catalog.source_of(tm), tm.source)
        return not any(many(df, r) for r in po.object.term.pieces()[1])

    def possible(self, po: PredicateObject, o) -> bool:
        """The object may be this node, as far as templates and kinds tell."""
        term = po.object.term if po.object.parent is None else self.catalog.maps[po.object.parent].subject if po.object.parent in self.catalog.maps else None
        if term is None or isinstance(o, Var):
            return True
        if isinstance(o, Literal):
            return term.kind == "literal" and (term.how != "constant" or term.value == str(o.value))
        return term.kind == "iri" and _may_be(term, o.value)

    def of_group(self, triples: list[Triple], names: list[str]) -> list[Alternative]:
        fixed_types = [t for t in triples if isinstance(t.p, Iri) and t.p.value == RDF_TYPE]
        others = [t for t in triples if t not in fixed_types]
        if fixed_types and any(po.predicate == RDF_TYPE for n in names for po in self.catalog.maps[n].objects):
            others, fixed_types = triples, []
        per = [self.offers(t, names) for t in others]
        if not all(per):
            return []
        for t in fixed_types:
            if not self.offers(t, names):
                return []
        if not others:
            return [a for a in [self.types_only(fixed_types, names)] if a is not None]
        complete = set(names).intersection(*({o.map for o in offers} for offers in per))
        if complete:
            picks = [p for name in sorted(complete, key=names.index) for p in itertools.product(*([o for o in offers if o.map == name] for offers in per))]
        else:
            if _product(per) > MOST:
                return [self.by_triple(triples, names)]
            picks = list(itertools.product(*per))
        return [a for p in picks if (a := self.assigned(others, p, fixed_types, names)) is not None]

    def by_triple(self, triples: list[Triple], names: list[str]) -> Alternative:
        """Each triple a union of what offers it, joined with the others: as many parts as there are offers."""
        return self.united([self.of_group([t], names) for t in dict.fromkeys(triples)])

    @staticmethod
    def united(each: list[list[Alternative]]) -> Alternative:
        """The join of unions of alternatives."""
        from ..operators import solutions as S

        out = None
        for alternatives in each:
            one = S.union([S.Solutions(a.frame(), a.terms) for a in alternatives])
            out = one if out is None else S.join(out, one)
        names = tuple(dict.fromkeys(n for alternatives in each for a in alternatives for n in a.names))
        return Alternative(out.terms, lambda: out.df, names, max(a.filters for alternatives in each for a in alternatives))

    def assigned(self, triples: list[Triple], picks: tuple[Offer, ...], fixed_types: list[Triple], names: list[str]) -> Alternative | None:
        """The scans of one assignment, joined on the subject."""
        s = triples[0].s
        parts: list[tuple[Scan, dict[str, T.Term], T.Term]] = []
        used: dict[tuple, int] = {}
        filters = 0
        for t, offer in zip(triples, picks):
            tm = self.catalog.maps[offer.map]
            predicate = offer.several if offer.index == ANY else RDF_TYPE if offer.index is None else tm.objects[offer.index].predicate
            # maps of one table share a scan if the subject tells its rows apart
            rows = (tm.owner, tm.source, tm.subject.how, tm.subject.value) if tm.unique else (offer.map,)
            # a predicate asked twice pairs all its values, so it is read twice
            at = used.get((rows, predicate), 0)
            used[rows, predicate] = at + 1
            place = next((i for i, (scan, _, _) in enumerate(parts) if scan.key == (rows, at)), None)
            if place is None:
                scan = self.scan(offer.map)
                scan.key, scan.classes = (rows, at), set()
                terms: dict[str, T.Term] = {}
                _match(scan, scan.subject, s, terms)
                if scan.empty:
                    return None
                parts.append((scan, terms, scan.subject))
                place = len(parts) - 1
            scan, terms, _ = parts[place]
            scan.classes.update(tm.classes)
            if offer.index == ANY:
                filters += not isinstance(t.o, Var)
                self.unfolded(scan, tm, offer, t, terms)
                if scan.empty:
                    return None
                continue
            if isinstance(t.p, Var):
                _match(scan, scan.iris([predicate]), t.p, terms)
            term = scan.iris([t.o.value] if isinstance(t.o, Iri) else list(tm.classes)) if offer.index is None else scan.object(tm.objects[offer.index])
            filters += not isinstance(t.o, Var)
            _match(scan, term, t.o, terms)
            if scan.empty:
                return None
        if isinstance(s, Iri):
            filters += 1
        # classes: of a map that is read anyway, or looked up in the others
        checks: list[str] = []
        for t in fixed_types:
            have = {c for scan, _, _ in parts for c in scan.classes}
            if isinstance(t.o, Iri):
                if t.o.value not in have:
                    checks.append(t.o.value)
            elif isinstance(t.o, Var):
                scan, terms, _ = parts[0]
                everywhere = {c for n in names for c in self.catalog.maps[n].classes}
                if everywhere <= have:
                    _match(scan, scan.iris(sorted(have)), t.o, terms)
                else:
                    found = self.one_type(t, names)
                    if found is None:
                        return None
                    parts.append((_Ready(found), dict(found.terms), found.subject))
            else:
                return None
        terms: dict[str, T.Term] = {}
        joins: list[list[Column]] = []
        for i, (_, own, subject) in enumerate(parts):
            conditions = []
            if i:
                same = T.equal(parts[0][2], subject)
                if same is None:
                    return None
                conditions.append(same)
            for v, term in own.items():
                if v not in terms:
                    terms[v] = term
                elif not (isinstance(s, Var) and v == s.name):
                    same = T.equal(terms[v], term)
                    if same is None:
                        return None
                    conditions.append(same)
            joins.append(conditions)

        def make() -> DataFrame:
            df = None
            for (scan, _, _), conditions in zip(parts, joins):
                one = scan.frame()
                if df is None:
                    df = one
                    continue
                on = conditions[0]
                for c in conditions[1:]:
                    on = on & c
                df = df.join(one, on)
            for c in checks:
                found = self.one_type(Triple(Var("~s"), Iri(RDF_TYPE), Iri(c)), names)
                df = df.join(found.make(), T.equal(parts[0][2], found.subject), "left_semi")
            return df.select(*dict.fromkeys(c for t in terms.values() for c in t.cols)) if terms else df.select(F.lit(1).alias(fresh()))

        return Alternative(terms, make, tuple(sorted({p.map for p in picks})), filters)

    def unfolded(self, scan: Scan, tm: TriplesMap, offer: Offer, t: Triple, terms: dict[str, T.Term]) -> None:
        """The triple of a variable predicate: every pair of predicate and object that a row has, from one reading of it."""
        found: list[tuple[str, T.Term, Column]] = []
        for i in offer.several:
            if i is None:
                wanted = [t.o.value] if isinstance(t.o, Iri) else tm.classes
                found += [(RDF_TYPE, T.Term("iri", (scan.made(F.lit(c), "string"),), ("string",), ("", "")), F.lit(True)) for c in wanted]
                continue
            mark = len(scan.conditions)
            term = scan.object(tm.objects[i])
            there = F.lit(True)
            for c in scan.conditions[mark:]:  # what makes no triple leaves the row's others
                there = there & c
            del scan.conditions[mark:]
            if not isinstance(t.o, Var):
                same = T.is_iri(term, t.o.value) if isinstance(t.o, Iri) else T.is_literal(term, t.o)
                if same is None:
                    continue
                there = there & same
            found.append((tm.objects[i].predicate, term, there))
        if not found:
            scan.empty = True
            return
        form = T.unified([term for _, term, _ in found])
        pairs = [F.when(there, F.struct(F.lit(p).alias("p"), *[c.alias(f"o{k}") for k, c in enumerate(T.fitted(term, form))])) for p, term, there in found]
        pair = scan.each(F.filter(F.array(*pairs), lambda x: x.isNotNull()), "struct")
        scan.out.remove(pair)
        names = [fresh() for _ in range(1 + len(form.types))]
        for name, part, kind in zip(names, ["p", *[f"o{k}" for k in range(len(form.types))]], ["string", *form.types]):
            scan.generated.append(T.column(pair).getField(part).alias(name))
            scan.types[name] = kind
            scan.out.append(name)
        _match(scan, T.Term("iri", (names[0],), ("string",), ("", "")), t.p, terms)
        if isinstance(t.o, Var):
            _match(scan, replace(form, cols=tuple(names[1:]), certain=True), t.o, terms)

    def types_only(self, types: list[Triple], names: list[str]) -> Alternative | None:
        """A star of classes only: each subject once for each class, though several maps have it."""
        s = types[0].s
        out = self.one_type(types[0], names)
        for t in types[1:]:
            other = self.one_type(t, names)
            if out is None or other is None:
                return None
            out = self.both_types(s, out, other)
        return out

    @staticmethod
    def both_types(s, out: Alternative, other: Alternative) -> Alternative | None:
        """Subjects of both, with the variables of both."""
        terms = dict(out.terms)
        conditions = [T.equal(out.subject, other.subject)]
        for v, term in other.terms.items():
            if v not in terms:
                terms[v] = term
            elif not (isinstance(s, Var) and v == s.name):
                conditions.append(T.equal(terms[v], term))
        if any(c is None for c in conditions):
            return None
        how = "inner" if len(terms) > len(out.terms) else "left_semi"

        def make() -> DataFrame:
            on = conditions[0]
            for c in conditions[1:]:
                on = on & c
            return out.make().join(other.make(), on, how)

        return Alternative(terms, make, out.names, out.filters, subject=out.subject)

    def one_type(self, t: Triple, names: list[str]) -> Alternative | None:
        s, wanted = t.s, t.o
        parts = []
        for name in names:
            tm = self.catalog.maps[name]
            classes = [c for c in tm.classes if isinstance(wanted, Var) or isinstance(wanted, Iri) and c == wanted.value]
            if not classes:
                continue
            scan = self.scan(name)
            terms: dict[str, T.Term] = {}
            _match(scan, scan.subject, s, terms)
            if isinstance(wanted, Var):
                _match(scan, scan.iris(classes), wanted, terms)
            if not scan.empty:
                parts.append((scan, terms))
        if not parts:
            return None
        forms = {"~subject": T.unified([scan.subject for scan, _ in parts])} | {v: T.unified([t[v] for _, t in parts]) for v in parts[0][1]}
        named = {v: replace(f, cols=tuple(fresh() for _ in f.types)) for v, f in forms.items()}

        def make() -> DataFrame:
            frames = []
            for scan, terms in parts:
                cols = [c.alias(n) for v, f in named.items() for c, n in zip(T.fitted(scan.subject if v == "~subject" else terms[v], forms[v]), f.cols)]
                frames.append(scan.frame().select(*cols))
            df = frames[0]
            for f in frames[1:]:
                df = df.unionByName(f)
            return df.distinct() if len(frames) > 1 else df

        terms = {v: t for v, t in named.items() if v != "~subject"}
        return Alternative(terms, make, tuple(n.tm.name for n, _ in parts), int(isinstance(s, Iri)), subject=named["~subject"])

    def class_list(self, name: str) -> Alternative | None:
        """Every class that has a subject, once for each source: one row of each map tells.

        Answers ``SELECT DISTINCT ?c { ?s a ?c }`` without reading more.
        """
        out = fresh()
        if any(po.predicate == RDF_TYPE for tm in self.catalog.maps.values() for po in tm.objects):
            return None
        maps = [n for n, tm in self.catalog.maps.items() if tm.classes]
        with ThreadPoolExecutor(8) as pool:  # each looks for one row
            seen = {c for n, found in zip(maps, pool.map(self.has_rows, maps)) if found for c in self.catalog.maps[n].classes}
        frames = []
        if seen:
            frames.append(self.spark.createDataFrame([(c,) for c in sorted(seen)], f"`{out}` string"))
        for source in self.catalog.rdf_sources():
            triples = self.rows(source, LogicalSource(source.name))
            frames.append(triples.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "uri")).select(F.col("o").alias(out)).distinct())
        if not frames:
            return None

        def make() -> DataFrame:
            df = frames[0]
            for f in frames[1:]:
                df = df.unionByName(f)
            return df

        return Alternative({name: T.Term("iri", (out,), ("string",), ("", ""))}, make, tuple(self.catalog.maps))

    def has_rows(self, name: str) -> bool:
        """Whether a map has any subject: one row of it tells. What has is kept with the frames, what has not is looked up again."""
        if ("rows", name) not in self.loaded and not self.scan(name).frame().isEmpty():
            self.loaded["rows", name] = True
        return ("rows", name) in self.loaded

    # RDF sources

    def of_triples(self, triples: list[Triple], source: SourceSpec) -> Alternative:
        """A star over a triple table: one selection of it for each triple, joined on the subject."""
        if is_endpoint(source) and len(dict.fromkeys(triples)) > 1:
            return self.of_endpoint(Remote(source, tuple(dict.fromkeys(triples))))
        s = triples[0].s
        # labels of blank nodes hold within their source
        scope = f"{source.name}/" if len(self.catalog.rdf_sources()) > 1 else ""
        parts = []
        for t in triples:
            names = {c: fresh() for c in ("s", "p", "o")}
            df, terms = self.triples_of(t, source), {}
            if isinstance(s, Iri):
                df = df.where((F.col("s") == s.value) & (F.col("s_kind") == "uri"))
            if isinstance(t.p, Iri):
                df = df.where(F.col("p") == t.p.value)
            if isinstance(t.o, Iri):
                df = df.where((F.col("o") == t.o.value) & (F.col("o_kind") == "uri"))
            elif isinstance(t.o, Literal):
                v = t.o.value
                number = not isinstance(v, (str, bool))
                df = df.where((F.col("o").try_cast("double") == float(v) if number else F.col("o") == (str(v).lower() if isinstance(v, bool) else v)) & (F.col("o_kind") == "literal"))
                if t.o.lang:
                    df = df.where(F.col("o_lang") == t.o.lang)

            def labelled(kind: Column, c: Column) -> Column:
                return F.when(kind == "bnode", F.concat(F.lit(scope), c)).otherwise(c) if scope else c

            none = F.lit(None).cast("string")
            subject_ = F.struct(F.col("s_kind").alias("kind"), labelled(F.col("s_kind"), F.col("s")).alias("value"), none.alias("datatype"), none.alias("lang"))
            object_ = F.struct(F.col("o_kind").alias("kind"), labelled(F.col("o_kind"), F.col("o")).alias("value"), F.col("o_datatype").alias("datatype"), F.col("o_lang").alias("lang"))
            df = df.select(subject_.alias(names["s"]), F.col("p").alias(names["p"]), object_.alias(names["o"]))
            subject = T.Term("mixed", (names["s"],), (T.MIXED,))
            conditions = []
            for node, term in ((s, subject), (t.p, T.Term("iri", (names["p"],), ("string",), ("", ""))), (t.o, T.Term("mixed", (names["o"],), (T.MIXED,)))):
                if isinstance(node, Var):
                    if node.name in terms:
                        conditions.append(T.equal(terms[node.name], term))
                    else:
                        terms[node.name] = term
            for c in conditions:
                df = df.where(c)
            parts.append((df, terms, subject))
        terms, joins = {}, []
        for i, (_, own, subject) in enumerate(parts):
            conditions = [T.equal(parts[0][2], subject)] if i else []
            for v, term in own.items():
                if v not in terms:
                    terms[v] = term
                elif not (isinstance(s, Var) and v == s.name):
                    conditions.append(T.equal(terms[v], term))
            joins.append(conditions)

        def make() -> DataFrame:
            df = None
            for (one, _, _), conditions in zip(parts, joins):
                if df is None:
                    df = one
                    continue
                on = conditions[0]
                for c in conditions[1:]:
                    on = on & c
                df = df.join(one, on)
            return df.select(*dict.fromkeys(c for t in terms.values() for c in t.cols)) if terms else df.select(F.lit(1).alias(fresh()))

        return Alternative(terms, make, (source.name,), sum(not isinstance(t.o, Var) for t in triples) + isinstance(s, Iri))

    def triples_of(self, t: Triple, source: SourceSpec) -> DataFrame:
        """The triples (see ``sources.triples.COLUMNS``) that may match; an endpoint is asked for these only."""
        if not is_endpoint(source):
            return self.rows(source, LogicalSource(source.name))
        from ..sources.endpoint import read_endpoint

        return read_endpoint(self.spark, source.url, **{**source.params, "pattern": Remote(source, (t,), self.filters).pattern_of_one()})

    def told(self, remote: Remote) -> Remote:
        """With what is known of the query besides the triples."""
        wanted = None
        if self.uses is not None:
            kept, total = self.uses
            here: dict[str, int] = {}
            for t in remote.triples:
                for v in t.vars():
                    here[v] = here.get(v, 0) + 1
            wanted = frozenset(v for v, n in here.items() if v in kept or total.get(v, 0) > n)
        return replace(remote, filters=self.filters, wanted=wanted, distinct=self.distinct)

    def of_endpoint(self, remote: Remote, bound: str | None = None, keys: DataFrame | None = None) -> Alternative:
        """Triples that one endpoint answers together, as one query of its own; or for the IRIs ``keys`` of the variable ``bound`` only."""
        from ..sources.endpoint import PAGE, read_bound, read_select

        cols = {v: fresh() for v in remote.vars()}

        def make() -> DataFrame:
            asked = self.told(remote)
            sent = asked.sent()
            if bound is not None:
                df = read_bound(keys, remote.source.url, asked.text(bound), list(sent.values()), int(remote.source.params.get("page", PAGE)))
            else:
                df = read_select(self.spark, remote.source.url, asked.text(), list(sent.values()), remote.source.params)
            back = {v: F.col(x) for v, x in sent.items()}
            label = F.lit(f"{remote.source.name}/")
            scoped = len(self.catalog.rdf_sources()) > 1
            none = F.lit(None).cast(T.MIXED)

            def of(v: str) -> Column:
                if v not in back:
                    return none  # nothing else asks for it
                x = back[v]
                if not scoped:
                    return x
                return F.when(x.getField("kind") == "bnode", F.struct(x.getField("kind").alias("kind"), F.concat(label, x.getField("value")).alias("value"), x.getField("datatype").alias("datatype"), x.getField("lang").alias("lang"))).otherwise(x)

            return df.select(*[of(v).alias(c) for v, c in cols.items()]) if cols else df.select(F.lit(1).alias(fresh()))

        constants = sum(not isinstance(x, Var) for t in remote.triples for x in (t.s, t.o))
        return Alternative({v: T.Term("mixed", (c,), (T.MIXED,)) for v, c in cols.items()}, make, (remote.source.name,), constants, remote=remote)

    def bind(self, remote: Remote, known: dict[str, T.Term], df: DataFrame) -> Alternative | None:
        """The endpoint's part of a join, asked for the keys only that the solutions ``df`` bring; None where asking for all is better.

        It is where the solutions bind one of its variables to IRIs, are small by Spark's statistics (a checked size, as for a
        broadcast), and the endpoint counts more solutions than one page. A source's parameter ``bind`` ("always", "never") decides otherwise.
        """
        from ..sources.endpoint import PAGE, count

        how = remote.source.params.get("bind", "auto")
        shared = [v for v in remote.vars() if v in known and known[v].certain and known[v].kind == "iri"]
        if how == "never" or not shared:
            return None
        if how != "always":
            most = int(self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
            if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most:
                return None
            asked = self.told(remote)
            if count(remote.source.url, asked.text()) <= int(remote.source.params.get("page", PAGE)):
                return None
        v = shared[0]
        return self.of_endpoint(remote, v, df.select(T.value(known[v]).alias("key")).distinct())

    # stars that no subject template and no RDF source answers alone

    def across(self, triples: list[Triple]) -> list[Alternative]:
        """One part for each triple, from wherever it is offered, joined on the subject term."""
        if len(triples) < 2:
            return []
        singles = []
        for t in triples:
            star = self.star([t])
            if not star.alternatives:
                return []
            singles.append(star.alternatives)
        if _product(singles) > MOST:
            return [self.united(singles)]
        out = []
        for picked in itertools.product(*singles):
            terms: dict[str, T.Term] = {}
            joins, possible = [], True
            for a in picked:
                conditions = []
                for v, term in a.terms.items():
                    if v in terms:
                        same = T.equal(terms[v], term)
                        possible = possible and same is not None
                        conditions.append(same)
                    else:
                        terms[v] = term
                joins.append(conditions)
            if possible:
                out.append(Alternative(terms, _joined(picked, joins, terms), tuple(n for a in picked for n in a.names), sum(a.filters for a in picked)))
        return out


def _product(of: list[list]) -> int:
    out = 1
    for x in of:
        out *= len(x)
    return out


def _joined(picked, joins, terms):
    def make() -> DataFrame:
        df = None
        for a, conditions in zip(picked, joins):
            one = a.make()
            if df is None:
                df = one
                continue
            on = F.lit(True)
            for c in conditions:
                on = on & c
            df = df.join(one, on)
        return df.select(*dict.fromkeys(c for t in terms.values() for c in t.cols)) if terms else df

    return make


class _Ready:
    """An alternative that takes a scan's place."""

    def __init__(self, alternative: Alternative):
        self.alternative = alternative
        self.key: tuple = ()
        self.classes: set[str] = set()

    def frame(self) -> DataFrame:
        return self.alternative.make()


def _may_be(term: TermMap, iri: str) -> bool:
    """A term map may make this IRI: it has the constant parts, or its text column may hold any IRI."""
    if term.how == "constant":
        return term.value == iri
    pieces, cols = term.pieces()
    if len(cols) == 1 and "http://" in iri:
        return True  # decided by the column's type
    return iri.startswith(pieces[0]) and iri.endswith(pieces[-1])


def merge_remote(stars: list[Star], planner: Planner) -> list[Star]:
    """Stars that only one and the same endpoint answers, and that share variables, become one query to it."""
    out: list[Star] = []
    for star in stars:
        only = star.alternatives[0].remote if len(star.alternatives) == 1 else None
        if len(star.alternatives) == 1 and only is None:
            source = next((x for x in planner.catalog.rdf_sources() if (x.name,) == star.alternatives[0].names and is_endpoint(x)), None)
            only = Remote(source, tuple(dict.fromkeys(star.triples))) if source else None
        if only is None:
            out.append(star)
            continue
        for other in [x for x in out if len(x.alternatives) == 1 and isinstance(x.alternatives[0].remote, Remote)]:
            theirs = other.alternatives[0].remote
            if theirs.source is only.source and set(theirs.vars()) & set(only.vars()):
                out.remove(other)
                only = Remote(only.source, tuple(dict.fromkeys([*theirs.triples, *only.triples])))
        alone = len(only.triples) == 1  # nothing to join with so far
        made = replace(star.alternatives[0], remote=only) if alone else planner.of_endpoint(only)
        out.append(Star(list(only.triples), [made]))
    return out


def prune(stars: list[Star]) -> None:
    """Drops alternatives whose terms for a shared variable fit no alternative of another star."""
    changed = True
    while changed:
        changed = False
        for a, b in itertools.permutations(stars, 2):
            for v in a.vars() & b.vars():
                theirs = [x.terms[v] for x in b.alternatives if v in x.terms]
                kept = [x for x in a.alternatives if v not in x.terms or any(not T.disjoint(x.terms[v], y) for y in theirs)]
                if len(kept) < len(a.alternatives):
                    a.alternatives, changed = kept, True


def ordered(stars: list[Star], size_of=None) -> list[Star]:
    """Connected stars follow each other; among them those with more constants, then smaller ones, come first.

    ``size_of`` estimates a star's bytes; it is asked only where there is a choice.
    """
    if len(stars) < 3:
        size_of = None
    sizes = [size_of(s) if size_of else 0 for s in stars]
    left = list(stars)
    out: list[Star] = []
    seen: set[str] = set()

    def worth(star: Star):
        constants = max((a.filters for a in star.alternatives), default=9)
        at = stars.index(star)
        return (-constants, sizes[at], -len(star.triples), at)

    while left:
        near = [s for s in left if s.vars() & seen] or left
        best = min(near, key=worth)
        out.append(best)
        seen |= best.vars()
        left.remove(best)
    return out


def estimated_bytes(star: Star, planner: Planner) -> int:
    """What Spark's statistics say of the star's tables, looked up once for each; no data is read. What has no statistics counts as large."""
    return sum(planner.bytes_of(n) for a in star.alternatives for n in a.names)
