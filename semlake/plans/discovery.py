"""Builds a catalog's molecules from the sources themselves, and links between sources."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession

from ..rml.model import LogicalSource
from ..sources.registry import load
from . import terms as T
from .catalog import META_NAMESPACES, Catalog, Molecule, links_between, molecules_of, molecules_of_ontology
from .stars import Scan


def discover(spark: SparkSession, catalog: Catalog, links: bool = True, without: tuple[str, ...] = META_NAMESPACES, ontologies: dict[str, DataFrame] | None = None) -> Catalog:
    """Adds to the catalog the molecules of its RDF sources, and what links classes of different sources.

    A source with an entry in ``ontologies`` (triple tables by source) has the classes and predicates that its ontology states
    instead of those looked up in its data. Only names of classes and predicates come to the driver, never instances.
    """
    tables = {s.name: load(spark, s, LogicalSource(s.name)) for s in catalog.rdf_sources()}
    for name, triples in tables.items():
        found: dict[str, Molecule] = {}
        stated = molecules_of_ontology(ontologies[name]) if ontologies and name in ontologies else molecules_of(triples, without)
        for r in stated.toLocalIterator():
            m = found.setdefault(r["class"], Molecule(r["class"]))
            m.predicates.setdefault(r["predicate"], set()).update([r["range"]] if r["range"] else [])
            m.links.update([r["range"]] if r["range"] else [])
            m.sources.setdefault(name, set()).add(r["predicate"])
        for m in found.values():
            catalog.add_molecule(m)
    for m in catalog.derived().values():
        catalog.add_molecule(m)
    if links:
        for a, b in permutations(tables, 2):
            _add(catalog, links_between(tables[a], tables[b]))
        for name, triples in tables.items():
            _add(catalog, mapped_links(spark, catalog, triples))
    return catalog


def _add(catalog: Catalog, found: DataFrame) -> None:
    for r in found.toLocalIterator():
        m = catalog.molecules.setdefault(r["class"], Molecule(r["class"]))
        m.predicates.setdefault(r["predicate"], set()).add(r["to"])
        m.links.add(r["to"])


def mapped_links(spark: SparkSession, catalog: Catalog, triples: DataFrame) -> DataFrame:
    """(class, predicate, to): IRI objects of mapped sources that are typed subjects of this triple table."""
    from pyspark.sql import functions as F

    from ..sparql.ast import RDF_TYPE

    types = triples.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("y"), F.col("o").alias("to")).distinct()
    out = spark.createDataFrame([], "class string, predicate string, to string")
    for tm in catalog.maps.values():
        df = load(spark, catalog.source_of(tm), tm.source)
        for po in tm.objects:
            scan = Scan(spark, catalog, tm, df)
            o = scan.object(po)
            if o is None or o.kind != "iri":
                continue
            objects = scan.frame().select(T.value(o).alias("x")).distinct()
            met = objects.join(types, F.col("x") == F.col("y")).select("to").distinct()
            out = out.unionByName(met.select(F.explode(F.array(*map(F.lit, tm.classes))).alias("class"), F.lit(po.predicate).alias("predicate"), "to"))
    return out.distinct()
