"""The front door: a session, a catalog, queries as text."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from .functions.expressions import FunctionRegistry, registry
from .plans.algebra import show, translate
from .plans.catalog import Catalog
from .plans.compile import Compiled, compile_query
from .sparql.ast import XSD, QuerySpec
from .sparql.parser import parse
from .streaming.incremental import Trace, answers


@dataclass
class QueryResult:
    """A lazy result: nothing runs until rows are asked for."""

    compiled: Compiled
    form: str
    spec: QuerySpec
    planning: dict[str, float] = field(default_factory=dict)

    @property
    def df(self) -> DataFrame:
        return self.compiled.df

    @property
    def vars(self) -> list[str]:
        return self.compiled.names

    @property
    def trace(self) -> list[str]:
        return self.compiled.trace

    def stream(self, trace: Trace | None = None) -> Iterator[Row]:
        """Rows one by one, as partitions finish."""
        return answers(self.df, trace)

    def terms(self, trace: Trace | None = None) -> Iterator[dict]:
        """Solutions one by one as {variable: {type, value[, datatype][, xml:lang]}}, unbound ones left out."""
        kinds = [self.compiled.kinds[v] for v in self.vars]
        for row in answers(self.compiled.typed, trace):
            yield {v: _json_term(x, kind) for v, x, kind in zip(self.vars, row, kinds) if x is not None}

    def explain(self, physical: bool = False) -> str:
        """The algebra, what each star is answered from, and Spark's plan on demand."""
        text = show(translate(self.spec.where)) + "\n" + "\n".join(self.trace)
        if physical:
            text += "\n" + self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return text

    def to_dict(self) -> dict:
        """{vars, result, execTime, firstResult, totalRows}; result holds {variable: {type, value}}, or true/false for ASK.

        The whole result is in memory then; ``terms``, ``write_tsv`` and ``df`` serve larger ones.
        """
        trace = Trace(keep=False)
        if self.form == "ASK":
            result: object = bool(next(iter(self.stream(trace)))[0])
            trace.end()
        else:
            result = list(self.terms(trace))
        return {"vars": self.vars, "result": result, "execTime": trace.total, "firstResult": trace.first, "totalRows": 1 if self.form == "ASK" else len(result)}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)

    def write_tsv(self, path: str) -> None:
        """All rows as tab-separated files with a header."""
        self.df.write.option("header", True).option("sep", "\t").csv(path)

    def summary(self, name: str = "") -> dict:
        """One line of a benchmark: qname, decompositionTime, planningTime, firstResult, overallExecTime, status, cardinality."""
        trace = Trace(keep=False)
        n = sum(1 for _ in self.stream(trace))
        return {
            "qname": name, "decompositionTime": self.planning.get("parse", 0.0), "planningTime": self.planning.get("plan", 0.0),
            "firstResult": trace.first, "overallExecTime": trace.total, "status": "done", "cardinality": n,
        }


#: Integer types that a source's columns have; a result calls them integers.
_INTEGERS = {XSD + x for x in ("byte", "short", "int", "long")}


def _json_term(x, kind: tuple[str, str | None, str | None] | None) -> dict:
    """A term as results show it; ``kind`` is (type, datatype, language) of a plain value, a struct says so itself."""
    if kind is None:
        what, x, datatype, lang = x
    else:
        what, datatype, lang = kind
    if isinstance(x, bool):
        x = str(x).lower()
    elif hasattr(x, "isoformat"):
        x = x.isoformat()
    if what != "literal":
        return {"type": what, "value": str(x)}
    if lang:
        return {"type": "literal", "value": str(x), "xml:lang": lang}
    if datatype is None or datatype == XSD + "string":
        return {"type": "literal", "value": str(x)}
    return {"type": "typed-literal", "value": str(x), "datatype": XSD + "integer" if datatype in _INTEGERS else datatype}


class Engine:
    """Answers SPARQL over a catalog with one Spark session.

    Sources' frames (schemas, lists of files) and which maps have rows are kept from one
    query to the next; ``refresh`` forgets them, for sources whose files changed.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, functions: FunctionRegistry = registry):
        self.spark, self.catalog, self.functions = spark, catalog, functions
        self.loaded: dict = {}

    def refresh(self) -> None:
        self.loaded.clear()

    def query(self, text: str) -> QueryResult:
        began = time.perf_counter()
        spec = parse(text)
        parsed = time.perf_counter()
        compiled = compile_query(self.spark, self.catalog, spec, self.functions, self.loaded)
        return QueryResult(compiled, spec.form, spec, {"parse": parsed - began, "plan": time.perf_counter() - parsed})
