"""What the lake holds: sources, mappings, classes, predicates, and links between classes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rml.model import TriplesMap, load_rml
from ..sources.registry import SourceSpec, load
from ..sparql.ast import RDF_TYPE

#: This package's own default: namespaces whose classes describe other vocabularies rather than data. A parameter wherever it is used.
META_NAMESPACES = (
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#",
    "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/ns/sparql-service-description#", "http://www.openlinksw.com/schemas/virtrdf#",
    "http://rdfs.org/ns/void#", "http://purl.org/dc/dcam/", "http://www.w3.org/2004/02/skos/core#",
)


@dataclass
class Molecule:
    """A class: its predicates with the classes of their objects, its links, and which source offers which predicates."""

    root: str
    predicates: dict[str, set[str]] = field(default_factory=dict)
    links: set[str] = field(default_factory=set)
    sources: dict[str, set[str]] = field(default_factory=dict)

    def merge(self, other: Molecule) -> None:
        for p, ranges in other.predicates.items():
            self.predicates.setdefault(p, set()).update(ranges)
        self.links |= other.links
        for s, ps in other.sources.items():
            self.sources.setdefault(s, set()).update(ps)


class Catalog:
    """Sources by name, triples maps, RDF sources (which need no mapping), molecules."""

    def __init__(self, sources: list[SourceSpec] = (), maps: list[TriplesMap] = (), molecules: list[Molecule] = ()):
        self.sources = {s.name: s for s in sources}
        self.maps: dict[str, TriplesMap] = {}
        self.molecules: dict[str, Molecule] = {}
        for m in maps:
            self.add_map(m)
        for m in molecules:
            self.add_molecule(m)

    def add_source(self, source: SourceSpec) -> None:
        self.sources[source.name] = source

    def add_map(self, tm: TriplesMap) -> None:
        self.maps[tm.name] = tm

    def add_molecule(self, m: Molecule) -> None:
        if m.root in self.molecules:
            self.molecules[m.root].merge(m)
        else:
            self.molecules[m.root] = m

    def source_of(self, tm: TriplesMap) -> SourceSpec:
        """The source that a map's logical source names, or the one source there is."""
        for name in (tm.owner, tm.source.source):
            if name in self.sources:
                return self.sources[name]
        mapped = [s for s in self.sources.values() if not self.is_rdf(s)]
        if len(mapped) == 1:
            return mapped[0]
        raise ValueError(f"{tm.name}: no source {tm.source.source!r}")

    @staticmethod
    def is_rdf(source: SourceSpec) -> bool:
        return source.format.lower() in ("ntriples", "nt", "sparql_endpoint", "triples")

    def rdf_sources(self) -> list[SourceSpec]:
        return [s for s in self.sources.values() if self.is_rdf(s)]

    # the configuration format

    @classmethod
    def from_json(cls, config: str | Path | dict, base: str | Path | None = None) -> Catalog:
        """From ``{"templates": [...], "datasources": [...]}``; mapping files are looked up from ``base``."""
        if not isinstance(config, dict):
            base = base or Path(config).parent
            config = json.loads(Path(config).read_text())
        base = Path(base or ".")
        out = cls()
        for d in config.get("datasources", ()):
            params = d.get("params") or {}
            if isinstance(params, str):
                params = dict(x.split(":", 1) for x in params.split(";") if ":" in x)
            kind = str(d.get("type") or d.get("dstype") or "parquet").lower()
            source = SourceSpec(d.get("ID") or d["name"], kind, d.get("url", ""), {str(k): str(v) for k, v in params.items()})
            out.add_source(source)
            for file in d.get("mappings", ()):
                path = Path(file) if Path(file).is_absolute() else base / file
                for tm in load_rml(path.read_text()):
                    tm.owner = source.name
                    tm.name = tm.name if tm.name not in out.maps else f"{source.name}:{tm.name}"
                    out.add_map(tm)
        for t in config.get("templates", ()):
            m = Molecule(t["rootType"], links=set(t.get("linkedTo", ())))
            for p in t.get("predicates", ()):
                m.predicates.setdefault(p["predicate"], set()).update(p.get("range", ()))
            for s in t.get("datasources", ()):
                m.sources[s["datasource"]] = set(s.get("predicates", ()))
            out.add_molecule(m)
        for source in out.rdf_sources():
            offered = set().union(*(m.sources.get(source.name, set()) for m in out.molecules.values())) if out.molecules else set()
            source.predicates = tuple(sorted(offered | {RDF_TYPE})) if offered else None
        for m in out.derived().values():
            out.add_molecule(m)
        return out

    def to_json(self) -> dict:
        """The configuration format again; frames and mapping files are not part of it."""
        return {
            "templates": [
                {
                    "rootType": m.root, "linkedTo": sorted(m.links),
                    "predicates": [{"predicate": p, "range": sorted(r)} for p, r in sorted(m.predicates.items())],
                    "datasources": [{"datasource": s, "predicates": sorted(ps)} for s, ps in sorted(m.sources.items())],
                }
                for _, m in sorted(self.molecules.items())
            ],
            "datasources": [{"name": s.name, "ID": s.name, "url": s.url, "type": s.format, "params": {k: v for k, v in s.params.items() if k not in ("password", "username")}} for s in self.sources.values()],
        }

    # molecules

    def derived(self) -> dict[str, Molecule]:
        """Molecules from the mappings: classes, predicates, and ranges where objects are subjects of maps."""
        by_template: dict[str, set[str]] = {}
        for tm in self.maps.values():
            by_template.setdefault(_shape(tm.subject), set()).update(tm.classes)
        out: dict[str, Molecule] = {}
        for tm in self.maps.values():
            source = self.source_of(tm).name
            for c in tm.classes:
                m = out.setdefault(c, Molecule(c))
                offered = m.sources.setdefault(source, set())
                for po in tm.objects:
                    offered.add(po.predicate)
                    ranges = m.predicates.setdefault(po.predicate, set())
                    if po.object.parent:
                        ranges.update(self.maps[po.object.parent].classes if po.object.parent in self.maps else ())
                    elif po.object.term.classes:
                        ranges.update(po.object.term.classes)
                    elif po.object.term.kind == "iri" and po.object.term.how == "template":
                        ranges.update(by_template.get(_shape(po.object.term), ()))
                    m.links.update(ranges)
        return out

    def classes(self, spark: SparkSession) -> DataFrame:
        """(class, predicate, source), one row for each predicate that a source offers for a class."""
        merged: dict[str, Molecule] = {}
        for m in [*self.molecules.values(), *self.derived().values()]:
            merged.setdefault(m.root, Molecule(m.root)).merge(m)
        rows = [(m.root, p, s) for m in merged.values() for s, ps in m.sources.items() for p in sorted(ps)]
        return spark.createDataFrame(rows, "class string, predicate string, source string")

    def statistics(self, spark: SparkSession) -> DataFrame:
        """(class, predicate, triples): how many triples each class has by predicate, counted from the sources."""
        from .stars import Scan

        out = None
        for tm in self.maps.values():
            df = load(spark, self.source_of(tm), tm.source)
            for po in tm.objects:
                scan = Scan(spark, self, tm, df)
                term = scan.object(po)
                one = scan.frame().agg(F.count(F.lit(1)).alias("triples")) if term else None
                if one is not None:
                    one = one.select(F.explode(F.array(*map(F.lit, tm.classes))).alias("class"), F.lit(po.predicate).alias("predicate"), "triples")
                    out = one if out is None else out.unionByName(one)
        return out.groupBy("class", "predicate").agg(F.sum("triples").alias("triples"))

    def links(self, spark: SparkSession) -> DataFrame:
        """(class, predicate, to): predicates of which some object is a subject of a class's map, looked up in the data."""
        from . import terms as T
        from .stars import Scan

        out = None
        for tm in self.maps.values():
            df = load(spark, self.source_of(tm), tm.source)
            for po in tm.objects:
                scan = Scan(spark, self, tm, df)
                o = scan.object(po)
                if o is None or o.kind != "iri":
                    continue
                left = scan.frame().select(*T.columns(o)).distinct()
                for other in self.maps.values():
                    target = Scan(spark, self, other, load(spark, self.source_of(other), other.source))
                    condition = T.equal(o, target.subject)
                    if condition is None:
                        continue
                    met = left.join(target.frame(), condition, "left_semi").limit(1)
                    met = met.select(F.explode(F.array(*[F.struct(F.lit(a).alias("class"), F.lit(po.predicate).alias("predicate"), F.lit(b).alias("to")) for a in tm.classes for b in other.classes])).alias("l")).select("l.*")
                    out = met if out is None else out.unionByName(met)
        if out is None:
            return spark.createDataFrame([], "class string, predicate string, to string")
        return out.distinct()


def molecules_of(triples: DataFrame, without: tuple[str, ...] = META_NAMESPACES) -> DataFrame:
    """(class, predicate, range) of a triple table: range is a class of the objects, or null. Classes of the namespaces ``without`` are left out."""
    meta = F.lit(False)
    for ns in without:
        meta = meta | F.col("o").startswith(ns)
    types = triples.where((F.col("p") == RDF_TYPE) & ~meta).select(F.col("s").alias("x"), F.col("o").alias("class")).distinct()
    rest = triples.where(F.col("p") != RDF_TYPE).select("s", F.col("p").alias("predicate"), F.when(F.col("o_kind") != "literal", F.col("o")).alias("o"))
    typed = rest.join(types, rest["s"] == types["x"]).select("class", "predicate", "o").distinct()
    ranges = types.select(F.col("x").alias("y"), F.col("class").alias("range"))
    return typed.join(ranges, typed["o"] == ranges["y"], "left").select("class", "predicate", "range").distinct()


def links_between(triples: DataFrame, others: DataFrame) -> DataFrame:
    """(class, predicate, to): objects of one triple table that are typed subjects of another."""
    types = triples.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("x"), F.col("o").alias("class")).distinct()
    objects = triples.where((F.col("o_kind") == "uri") & (F.col("p") != RDF_TYPE)).select("s", F.col("p").alias("predicate"), "o").distinct()
    there = others.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("y"), F.col("o").alias("to")).distinct()
    return objects.join(types, objects["s"] == types["x"]).join(there, objects["o"] == there["y"]).select("class", "predicate", "to").distinct()


RDFS = "http://www.w3.org/2000/01/rdf-schema#"


def molecules_of_ontology(triples: DataFrame) -> DataFrame:
    """(class, predicate, range) that an ontology states: properties with ``rdfs:domain`` and ``rdfs:range``, also those of the
    domain's superclasses. ``range`` is null for literals and where none is stated."""
    from ..sparql.ast import XSD

    def of(p: str, a: str, b: str) -> DataFrame:
        return triples.where((F.col("p") == RDFS + p) & (F.col("o_kind") == "uri")).select(F.col("s").alias(a), F.col("o").alias(b)).distinct()

    domain, ranges, parents = of("domain", "predicate", "class"), of("range", "predicate", "range"), of("subClassOf", "sub", "class")
    # superclasses of superclasses: the hierarchy's depth bounds the rounds, and each round's pairs are new
    known = domain
    while True:
        down = parents.join(known, "class").select("predicate", F.col("sub").alias("class")).distinct()
        new = down.join(known, ["predicate", "class"], "left_anti")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    stated = ranges.where(~F.col("range").startswith(XSD) & (F.col("range") != RDFS + "Literal"))
    return known.join(stated, "predicate", "left").select("class", "predicate", "range").distinct()


#: The namespace of this package's own metadata graphs; others are named by the caller.
LAKE = "http://ex.org/lake#"


def catalog_of_graph(triples: DataFrame, vocabulary: str = LAKE) -> Catalog:
    """A catalog that a metadata graph describes.

    Of ``vocabulary``: classes are RDFMT with ``source`` (that has a ``datasource``) and ``hasProperty`` (that has a
    ``predicate`` and, through ``linkedTo``, an ``rdfmt``); sources are DataSource with ``url`` and ``dataSourceType``. Only
    names of classes, predicates and sources come to the driver.
    """
    p = lambda name, a, b: triples.where(F.col("p") == vocabulary + name).select(F.col("s").alias(a), F.col("o").alias(b)).distinct()
    of_type = lambda name, a: triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == vocabulary + name)).select(F.col("s").alias(a)).distinct()
    found = of_type("DataSource", "id").join(p("url", "id", "url"), "id").join(p("dataSourceType", "id", "kind"), "id", "left")
    sources = [SourceSpec(r["id"], (r["kind"] or "sparql_endpoint").rpartition("/")[2].rpartition("#")[2].lower(), r["url"]) for r in found.toLocalIterator()]
    linked = p("linkedTo", "property", "link").join(p("rdfmt", "link", "range"), "link").select("property", "range")
    rows = of_type("RDFMT", "class").join(p("source", "class", "source"), "class").join(p("datasource", "source", "datasource"), "source")
    rows = rows.join(p("hasProperty", "class", "property"), "class").join(p("predicate", "property", "predicate"), "property").join(linked, "property", "left")
    out = Catalog(sources)
    for r in rows.select("class", "datasource", "predicate", "range").distinct().toLocalIterator():
        there = {r["range"]} if r["range"] else set()
        out.add_molecule(Molecule(r["class"], {r["predicate"]: there}, set(there), {r["datasource"]: {r["predicate"]}}))
    return out


def graph_of_catalog(spark: SparkSession, catalog: Catalog, vocabulary: str = LAKE) -> DataFrame:
    """The catalog's molecules and sources as a triple table that ``catalog_of_graph`` reads again."""
    from ..sources.triples import triple_frame

    uri, text = lambda x: ("uri", x, None, None), lambda x: ("literal", x, None, None)
    out = []
    for s in catalog.sources.values():
        at = uri(s.name)
        out += [(at, RDF_TYPE, uri(vocabulary + "DataSource")), (at, vocabulary + "url", text(s.url)), (at, vocabulary + "dataSourceType", text(s.format))]
    merged: dict[str, Molecule] = {}
    for m in [*catalog.molecules.values(), *catalog.derived().values()]:
        merged.setdefault(m.root, Molecule(m.root)).merge(m)
    for m in merged.values():
        at = uri(m.root)
        out.append((at, RDF_TYPE, uri(vocabulary + "RDFMT")))
        for i, (name, ps) in enumerate(sorted(m.sources.items())):
            source = uri(f"{m.root}/source/{i}")
            out += [(at, vocabulary + "source", source), (source, vocabulary + "datasource", uri(name))]
        for i, (predicate, ranges) in enumerate(sorted(m.predicates.items())):
            prop = uri(f"{m.root}/property/{i}")
            out += [(at, vocabulary + "hasProperty", prop), (prop, vocabulary + "predicate", uri(predicate))]
            for k, r in enumerate(sorted(ranges)):
                link = uri(f"{m.root}/property/{i}/{k}")
                out += [(prop, vocabulary + "linkedTo", link), (link, vocabulary + "rdfmt", uri(r))]
    return triple_frame(spark, out)


def _shape(term) -> str:
    """A template without the names of its columns."""
    return "{}".join(term.pieces()[0])
