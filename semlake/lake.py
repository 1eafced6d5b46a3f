"""The star-schema tables as a semantic lake: one mapping for each table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .engine import Engine
from .plans.catalog import Catalog
from .rml.model import LogicalSource, ObjectMap, PredicateObject, TermMap, TriplesMap, iri_map, ref
from .sources.registry import SourceSpec

BASE = "http://ex.org"
EX = BASE + "/v#"


def mapping(table: str, subject: str, classes: str, *, map_name: str | None = None, owner: str = "lake", unique: bool = True, **predicates) -> TriplesMap:
    """A triples map; a predicate is a column, ``/template`` for an IRI below the base, or an object map."""
    def made(x) -> ObjectMap:
        if isinstance(x, ObjectMap):
            return x
        return iri_map(BASE + x) if x.startswith("/") else ref(x)

    tm = TriplesMap(map_name or table, LogicalSource(owner, table=table), TermMap("template", BASE + subject, "iri"), tuple(EX + c for c in classes.split()), [PredicateObject(EX + p.rstrip("_"), made(x)) for p, x in predicates.items()], unique)
    tm.owner = owner
    return tm


def maps() -> list[TriplesMap]:
    return [
        mapping("region", "/region/{r_regionkey}", "Region", name_="r_name"),
        mapping("nation", "/nation/{n_nationkey}", "Nation", name_="n_name", inRegion="/region/{n_regionkey}"),
        mapping("customer", "/customer/{c_custkey}", "Customer Party", name_="c_name", acctbal="c_acctbal", segment="c_mktsegment", ofNation="/nation/{c_nationkey}"),
        mapping("supplier", "/supplier/{s_suppkey}", "Supplier Party", name_="s_name", acctbal="s_acctbal", ofNation="/nation/{s_nationkey}"),
        mapping("part", "/part/{p_partkey}", "Part", name_="p_name", brand="p_brand", ptype="p_type", size="p_size", price="p_retailprice"),
        mapping("orders", "/order/{o_orderkey}", "Order", status="o_orderstatus", total="o_totalprice", date="o_orderdate", priority="o_orderpriority", by="/customer/{o_custkey}"),
        mapping(
            "lineitem", "/lineitem/{l_orderkey}-{l_linenumber}-{l_partkey}-{l_suppkey}", "LineItem", unique=False, ofOrder="/order/{l_orderkey}", ofPart="/part/{l_partkey}", ofSupplier="/supplier/{l_suppkey}",
            qty="l_quantity", extprice="l_extendedprice", discount="l_discount", tax="l_tax", flag="l_returnflag", linestatus="l_linestatus", shipped="l_shipdate",
        ),
        mapping("events", "/event/{event_id}", "Event", etype="event_type", value="value", ts="ts", user="/customer/{user_id}", props="props", k="props.k"),
        mapping("documents", "/doc/{doc_id}", "Document", text="text", lang="lang", source_="source", nchars="n_chars"),
        mapping("labels", "/doc/{doc_id}", "Document", quality="quality", toxic="toxic"),
        mapping("pages", "/page/{page_id}", "Page", url=ObjectMap(TermMap("template", "{url}", "iri")), html="html"),
        mapping("conversations", "/turn/{conv_id}-{turn}", "Turn", role="role", text="text"),
        mapping("benchmark", "/item/{item_id}", "Item", text="text"),
        mapping("embeddings", "/vec/{vec_id}", "Vector", label="label", component="embedding[*]"),
    ]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, Catalog([SourceSpec("lake", "parquet", sf_dir)], maps()))
