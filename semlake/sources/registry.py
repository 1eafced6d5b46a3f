"""Sources by format. Every one becomes a lazy DataFrame of Spark's own readers."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rml.model import LogicalSource


@dataclass
class SourceSpec:
    """A named source.

    ``url`` is a folder, a file, a JDBC URL or an endpoint; ``params`` are reader options
    (``user``, ``password``, ``sep``, ``schema``, ``rowTag``, ``partitionColumn``, ...).
    ``frames`` hands in tables that are DataFrames already.
    """

    name: str
    format: str = "parquet"
    url: str = ""
    params: dict[str, str] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    #: RDF sources answer any predicate; None: what the mappings say.
    predicates: tuple[str, ...] | None = None


Reader = Callable[[SparkSession, SourceSpec, LogicalSource], DataFrame]
FORMATS: dict[str, Reader] = {}
DATABASES = ("jdbc", "mysql", "postgresql", "sqlserver", "derby")


def register_format(*names: str):
    """Makes a reader known under these names."""

    def add(reader: Reader) -> Reader:
        for name in names:
            FORMATS[name.lower()] = reader
        return reader

    return add


def load(spark: SparkSession, source: SourceSpec, logical: LogicalSource) -> DataFrame:
    """The rows of a logical source."""
    table = logical.table or logical.source
    if table in source.frames:
        return source.frames[table]
    if logical.query and source.format.lower() not in DATABASES:
        return spark.sql(logical.query)
    if source.format.lower() not in FORMATS:
        raise ValueError(f"{source.name}: no reader for format {source.format!r}")
    return FORMATS[source.format.lower()](spark, source, logical)


def _path(source: SourceSpec, logical: LogicalSource, *endings: str) -> str:
    """The file: the logical source's own path, inside the source's folder unless it is absolute."""
    name = logical.table or logical.source
    if not name or name == source.name or source.url.lower().endswith(endings):
        return source.url
    if "://" in name or os.path.isabs(name) or not source.url:
        return name
    name = name if name.lower().endswith(endings) else name + endings[0]
    return f"{source.url.rstrip('/')}/{name}"


@register_format("parquet")
def _parquet(spark, source, logical):
    return spark.read.options(**_options(source)).parquet(_path(source, logical, ".parquet"))


@register_format("orc")
def _orc(spark, source, logical):
    return spark.read.options(**_options(source)).orc(_path(source, logical, ".orc"))


def _options(source: SourceSpec, **more) -> dict:
    return {**more, **{k: v for k, v in source.params.items() if k not in ("schema", "username", "password", "groupBy", "collect")}}


def _text(sep: str, ending: str) -> Reader:
    def read(spark, source, logical):
        reader = spark.read.options(**_options(source, header=True, sep=sep))
        if "schema" in source.params:
            reader = reader.schema(source.params["schema"])
        return reader.csv(_path(source, logical, ending, ".csv", ".tsv", ".txt"))

    return read


for _names, _sep, _ending in ((("csv", "local_csv", "hadoop_csv", "spark_csv"), ",", ".csv"), (("tsv", "local_tsv", "hadoop_tsv", "spark_tsv"), "\t", ".tsv")):
    register_format(*_names)(_text(_sep, _ending))


@register_format("json", "local_json", "hadoop_json", "spark_json", "mongodb", "document")
def _json(spark, source, logical):
    """JSON lines (``multiLine`` for one document a file); also a dump of a document store's collection.

    With the parameters ``groupBy`` and ``collect`` documents of one key become one, with the set of that field's values as an array of its name.
    """
    reader = spark.read.options(**_options(source))
    if "schema" in source.params:
        reader = reader.schema(source.params["schema"])
    df = reader.json(_path(source, logical, ".json", ".jsonl"))
    if "groupBy" in source.params:
        from .graph import grouped

        df = grouped(df, source.params["groupBy"], source.params["collect"], source.params["collect"])
    return df


@register_format("neo4j", "property_graph")
def _graph(spark, source, logical):
    """A property graph as two tables, ``nodes`` (id, label, properties) and ``edges`` (src, type, dst).

    The iterator says what a row is: ``Label`` for the nodes of a label, ``Label/TYPE/Label`` for pairs (n, o) of nodes with
    an edge of that type from one to the other; ``*`` is any label or type.
    """
    from .graph import hop

    nodes, edges = (load(spark, SourceSpec(source.name, source.params.get("stored", "parquet"), source.url, {}, source.frames), LogicalSource(source.name, table=t)) for t in ("nodes", "edges"))
    steps = [None if x == "*" else x for x in (logical.iterator or logical.table or "*").split("/")]
    if len(steps) == 3:
        return hop(nodes, edges, *steps)
    if len(steps) != 1:
        raise ValueError(f"{source.name}: {logical.iterator!r} is neither a label nor label/type/label")
    return nodes.where(F.col("label") == steps[0]) if steps[0] else nodes


@register_format("xml", "local_xml", "hadoop_xml", "spark_xml")
def _xml(spark, source, logical):
    """Elements of the iterator's last step are rows; attributes are columns ``_name``."""
    tag = source.params.get("rowTag") or (logical.iterator or "").rstrip("/").rpartition("/")[2] or "row"
    reader = spark.read.options(**_options(source, rowTag=tag.removesuffix("[*]")))
    if "schema" in source.params:
        reader = reader.schema(source.params["schema"])
    return reader.xml(_path(source, logical, ".xml"))


@register_format(*DATABASES)
def _jdbc(spark, source, logical):
    """A table or query; ``partitionColumn`` with its bounds and ``numPartitions`` splits the read. The driver's jar must be there.

    With the parameter ``catalog=true`` tables are read through a catalog of the database: filters, joins of its tables, aggregates, sorts
    and limits then become part of the SQL that it is sent, as far as its dialect can say them.
    """
    params = dict(source.params)
    if params.pop("catalog", "false") == "true" and not logical.query:
        return _of_catalog(spark, source, logical, params)
    params["user"] = params.pop("username", params.get("user", ""))
    url = source.url if source.url.startswith("jdbc:") else f"jdbc:{source.format.lower()}://{source.url}"
    reader = spark.read.format("jdbc").option("url", url).options(**params)
    return reader.option("dbtable", f"({logical.query}) of_map" if logical.query else logical.table or logical.source).load()


def _of_catalog(spark: SparkSession, source: SourceSpec, logical: LogicalSource, params: dict) -> DataFrame:
    name = "semlake_" + re.sub(r"\W", "_", source.name)
    prefix = f"spark.sql.catalog.{name}"
    params["user"] = params.pop("username", params.get("user", ""))
    url = source.url if source.url.startswith("jdbc:") else f"jdbc:{source.format.lower()}://{source.url}"
    spark.conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for k, v in {"url": url, **params}.items():
        spark.conf.set(f"{prefix}.{k}", v)
    spark.conf.set("spark.sql.optimizer.datasourceV2JoinPushdown", "true")
    table = logical.table or logical.source
    return spark.table(f"{name}." + ".".join(f"`{x}`" for x in table.split(".")))


@register_format("ntriples", "nt", "sparql_endpoint", "triples")
def _triples(spark, source, logical):
    """A triple table (s, s_kind, p, o, o_kind, o_datatype, o_lang): from N-Triples text, or Parquet of these columns."""
    from .triples import read_ntriples

    if source.url.lower().endswith(".parquet") or source.params.get("stored") == "parquet":
        return spark.read.parquet(source.url)
    if source.url.startswith(("http://", "https://")):
        from .endpoint import read_endpoint

        return read_endpoint(spark, source.url, **source.params)
    return read_ntriples(spark, source.url or logical.source, source.params.get("malformed", "fail"))


def browse(spark: SparkSession, source: SourceSpec, logical: LogicalSource, n: int = 10) -> DataFrame:
    """The first rows of a table or collection."""
    return load(spark, source, logical).limit(n)


def tables(spark: SparkSession, source: SourceSpec) -> list[str]:
    """Names of a source's tables: the frames handed in, or the entries of its folder by the session's file system."""
    if source.frames:
        return sorted(source.frames)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(source.url)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at))


def sizes(spark: SparkSession, source: SourceSpec, logical: list[LogicalSource]) -> DataFrame:
    """(source, table, rows) of these tables, counted."""
    out = None
    for ls in logical:
        one = load(spark, source, ls).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(source.name).alias("source"), F.lit(ls.table or ls.source).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
