"""SPARQL endpoints as a partitioned data source: one partition a page of triples."""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .triples import COLUMNS

PAGE = 10_000


def ask(url: str, query: str, timeout: float = 60.0) -> list[dict]:
    """The bindings of a SELECT, by HTTP POST; failures raise."""
    data = urllib.parse.urlencode({"query": query, "format": "application/sparql-results+json"}).encode()
    request = urllib.request.Request(url, data, {"Accept": "application/sparql-results+json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read().decode())["results"]["bindings"]


class _Page(InputPartition):
    def __init__(self, offset: int, size: int):
        self.offset, self.size = offset, size


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url, self.pattern, self.page = options["url"], options.get("pattern", "?s ?p ?o"), int(options.get("page", PAGE))

    def partitions(self):
        total = int(ask(self.url, f"SELECT (COUNT(*) AS ?n) WHERE {{ {self.pattern} }}")[0]["n"]["value"])
        return [_Page(at, self.page) for at in range(0, max(total, 1), self.page)]

    def read(self, part):
        query = f"SELECT ?s ?p ?o WHERE {{ {self.pattern} }} ORDER BY ?s ?p ?o LIMIT {part.size} OFFSET {part.offset}"
        for b in ask(self.url, query):
            s, o = b["s"], b["o"]
            kind = "literal" if o["type"] == "typed-literal" else o["type"]
            yield s["value"], s["type"], b["p"]["value"], o["value"], kind, o.get("datatype"), o.get("xml:lang")


class _SelectReader(DataSourceReader):
    """Any SELECT, page by page in the order of all its variables."""

    def __init__(self, options):
        self.url, self.query, self.page = options["url"], options["query"], int(options.get("page", PAGE))
        self.names = options["vars"].split()

    def partitions(self):
        total = count(self.url, self.query)
        return [_Page(at, self.page) for at in range(0, max(total, 1), self.page)]

    def read(self, part):
        by = " ".join("?" + n for n in self.names)
        for b in ask(self.url, f"{self.query} ORDER BY {by} LIMIT {part.size} OFFSET {part.offset}"):
            yield tuple(_term(b.get(n)) for n in self.names)


def _term(x: dict | None) -> tuple | None:
    if x is None:
        return None
    return "literal" if x["type"] == "typed-literal" else x["type"], x["value"], x.get("datatype"), x.get("xml:lang")


class SelectSource(DataSource):
    """Options: url, query (a SELECT without ORDER BY, LIMIT, OFFSET), vars (its variables), page."""

    @classmethod
    def name(cls):
        return "sparql_select"

    def schema(self):
        return ", ".join(f"`{n}` struct<kind:string,value:string,datatype:string,lang:string>" for n in self.options["vars"].split())

    def reader(self, schema):
        return _SelectReader(self.options)


def read_select(spark: SparkSession, url: str, query: str, names: list[str], params: dict | None = None) -> DataFrame:
    """A column for each variable of a query that the endpoint answers."""
    spark.dataSource.register(SelectSource)
    more = {k: v for k, v in (params or {}).items() if k == "page"}
    return spark.read.format("sparql_select").options(url=url, query=query, vars=" ".join(names), **more).load()


#: Keys that are sent along with one query.
BOUND = 200
_BAD = re.compile(r'[\x00-\x20<>"{}|^`\\]')


def read_bound(keys: DataFrame, url: str, query: str, names: list[str], page: int = PAGE) -> DataFrame:
    """A column for each variable of a query that the endpoint answers for the IRIs in ``keys``' one column.

    ``query`` is a SELECT with ``%VALUES%`` where they belong. Each task sends its keys in groups of ``BOUND`` and pages
    through the answers. What is no IRI is asked for nothing.
    """
    schema = ", ".join(f"`{n}` struct<kind:string,value:string,datatype:string,lang:string>" for n in names)

    def run(batches):
        import pyarrow as pa

        term = pa.struct([(f, pa.string()) for f in ("kind", "value", "datatype", "lang")])
        by = " ".join("?" + n for n in names)
        for batch in batches:
            iris = [k for k in batch.column(0).to_pylist() if k and not _BAD.search(k)]
            for at in range(0, len(iris), BOUND):
                said = query.replace("%VALUES%", " ".join(f"<{k}>" for k in iris[at : at + BOUND]))
                offset = 0
                while True:
                    found = ask(url, f"{said} ORDER BY {by} LIMIT {page} OFFSET {offset}")
                    rows = [[_term(b.get(n)) for n in names] for b in found]
                    columns = [pa.array([None if r[i] is None else dict(zip(("kind", "value", "datatype", "lang"), r[i])) for r in rows], term) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    if len(found) < page:
                        break
                    offset += page

    return keys.mapInArrow(run, schema)


def count(url: str, query: str) -> int:
    """How many solutions a SELECT has, as the endpoint counts them."""
    return int(ask(url, f"SELECT (COUNT(*) AS ?n) WHERE {{ {{ {query} }} }}")[0]["n"]["value"])


class EndpointSource(DataSource):
    """Options: url, pattern (a triple pattern over ?s ?p ?o), page."""

    @classmethod
    def name(cls):
        return "sparql_endpoint"

    def schema(self):
        return ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema):
        return _Reader(self.options)


def read_endpoint(spark: SparkSession, url: str, **options) -> DataFrame:
    spark.dataSource.register(EndpointSource)
    return spark.read.format("sparql_endpoint").options(url=url, **{k: v for k, v in options.items() if k in ("pattern", "page")}).load()
