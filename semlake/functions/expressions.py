"""SPARQL expressions as Columns.

An error is NULL: SQL's three-valued logic is then SPARQL's error algebra, and a
filter drops the row. No cast may throw, so all go through ``try_cast``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import terms as T
from ..sparql.ast import XSD, Iri, Literal, Var



@dataclass
class Val:
    """A typed expression: kind is num, str, bool, time, iri, bnode, mixed or error."""

    kind: str
    col: Column | None = None
    datatype: str | None = None
    lang: str | None = None
    term: T.Term | None = None
    const: object = None


class FunctionRegistry:
    """Functions by IRI: ``registry.add(iri, lambda *columns: column)``. The result's kind is told by ``returns``."""

    def __init__(self):
        self.known: dict[str, tuple[Callable, str]] = {}

    def add(self, iri: str, function: Callable[..., Column], returns: str = "str") -> None:
        self.known[iri] = (function, returns)


registry = FunctionRegistry()

_RANGES = {
    "integer": (None, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "!=": "!="}


def _promoted(of: list[Val], division: bool = False) -> str:
    """The datatype of a sum, difference, product or quotient: the widest of its operands; integers divide to a decimal."""
    widest = 0
    for v in of:
        name = (v.datatype or "").removeprefix(XSD)
        rank = 0 if v.kind == "num" and name in _RANGES else {"decimal": 1, "float": 2}.get(name, 3) if v.kind == "num" else 3
        widest = max(widest, rank)
    return XSD + ("integer", "decimal", "float", "double")[max(widest, int(division))]


def _error(kind: str = "boolean") -> Column:
    return F.lit(None).cast(kind)


def _kind_of(spark_type: str) -> str:
    if T.is_number(spark_type):
        return "num"
    if spark_type == "boolean":
        return "bool"
    return "time" if spark_type in ("timestamp", "timestamp_ntz", "date") else "str"


class Compiler:
    """Expressions over variables that are kept in these terms; others are unbound."""

    def __init__(self, terms: dict[str, T.Term], functions: FunctionRegistry = registry):
        self.terms, self.functions = terms, functions

    def condition(self, expr) -> Column:
        return self.ebv(self.val(expr))

    # values

    def val(self, e) -> Val:
        if isinstance(e, Var):
            term = self.terms.get(e.name)
            if term is None:
                return Val("error", _error("string"))
            if term.kind == "literal":
                return Val(_kind_of(term.types[0]), T.columns(term)[0], term.xsd(), term.lang, term)
            return Val(term.kind, T.columns(term)[0] if term.kind == "mixed" else T.value(term), term=term)
        if isinstance(e, Iri):
            return Val("iri", F.lit(e.value), const=e.value)
        if isinstance(e, Literal):
            v = e.value
            if isinstance(v, bool):
                return Val("bool", F.lit(v), XSD + "boolean", const=v)
            if isinstance(v, (int, float, Decimal)):
                kind = "integer" if isinstance(v, int) else "double" if isinstance(v, float) else "decimal"
                return Val("num", F.lit(v), e.datatype or XSD + kind, const=v)
            if e.datatype in (XSD + "dateTime", XSD + "date"):
                return Val("time", F.lit(v).try_cast("timestamp_ntz"), e.datatype)
            return Val("str", F.lit(v), e.datatype or XSD + "string", e.lang, const=v)
        name, args = e.name, e.args
        if name in ("&&", "||"):
            a, b = (self.ebv(self.val(x)) for x in args)
            return Val("bool", a & b if name == "&&" else a | b, XSD + "boolean")
        if name == "!":
            return Val("bool", ~self.ebv(self.val(args[0])), XSD + "boolean")
        if name in _FLIP:
            return Val("bool", self.compare(name, self.val(args[0]), self.val(args[1])), XSD + "boolean")
        if name in ("+", "-", "*", "/"):
            both = [self.val(x) for x in args]
            a, b = map(self.number, both)
            made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": lambda x, y: F.try_divide(x.cast("double"), y.cast("double"))}[name](a, b)
            return Val("num", made, _promoted(both, name == "/"))
        if name in ("u-", "u+"):
            x = self.val(args[0])
            n = self.number(x)
            if isinstance(x.const, (int, float, Decimal)) and not isinstance(x.const, bool):
                v = -x.const if name == "u-" else x.const
                return Val("num", F.lit(v), _promoted([x]), const=v)
            return Val("num", F.try_subtract(F.lit(0), n) if name == "u-" else n, _promoted([x]))
        method = getattr(self, "_" + name.lower(), None) if name.isupper() else None
        if method:
            return method(*args)
        if name.startswith(XSD) and len(args) == 1:
            return self.cast(self.val(args[0]), name.removeprefix(XSD))
        if name in self.functions.known:
            function, returns = self.functions.known[name]
            return Val(returns, function(*[self.shown(self.val(a)) for a in args]))
        return Val("error", _error("string"))

    def shown(self, v: Val) -> Column:
        return v.col.getField("value") if v.kind == "mixed" else v.col

    def ebv(self, v: Val) -> Column:
        """The effective boolean value."""
        if v.kind == "bool":
            return v.col
        if v.kind == "num":
            return (v.col != 0) & ~F.isnan(v.col.cast("double"))
        if v.kind == "str":
            return F.length(v.col) > 0
        if v.kind == "mixed":
            text, datatype = v.col.getField("value"), v.col.getField("datatype")
            n = text.try_cast("double")
            number = datatype.isNotNull() & datatype.startswith(XSD) & ~datatype.isin(XSD + "string", XSD + "boolean", XSD + "dateTime", XSD + "date")
            says = F.when(datatype == XSD + "boolean", text.isin("true", "1")).when(number, F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))).when(datatype.isNull() | (datatype == XSD + "string"), F.length(text) > 0)
            return F.when(v.col.getField("kind") == "literal", says)
        return _error()

    def number(self, v: Val) -> Column:
        if v.kind == "num":
            return v.col
        if v.kind == "str":
            return v.col.try_cast("double")
        if v.kind == "mixed":
            return F.when(v.col.getField("kind") == "literal", v.col.getField("value").try_cast("double"))
        return _error("double")

    def text(self, v: Val) -> Column:
        """The text of a string literal, or of a literal by way of STR."""
        if v.kind in ("str", "iri", "bnode"):
            return v.col
        if v.kind == "mixed":
            return v.col.getField("value")
        if v.kind == "error":
            return _error("string")
        return v.col.cast("string")

    # comparisons

    def compare(self, op: str, a: Val, b: Val) -> Column:
        if "error" in (a.kind, b.kind):
            return _error()
        if b.kind == "mixed" and a.kind != "mixed" or a.kind == "str" and b.kind in ("num", "bool", "time"):
            return self.compare(_FLIP[op], b, a)
        if "iri" in (a.kind, b.kind) or "bnode" in (a.kind, b.kind):
            return self.same(op, a, b)
        x, y = a.col, b.col
        if a.kind == "mixed":
            literal = x.getField("kind") == "literal"
            text = x.getField("value")
            if b.kind == "mixed":
                n, m = text.try_cast("double"), y.getField("value").try_cast("double")
                both = n.isNotNull() & m.isNotNull()
                if op in ("=", "!="):
                    same = F.when(both & literal & (y.getField("kind") == "literal"), n == m).otherwise((text == y.getField("value")) & (x.getField("kind") == y.getField("kind")))
                    return same if op == "=" else ~same
                return F.when(literal & (y.getField("kind") == "literal"), F.when(both, _apply(op, n, m)).otherwise(_apply(op, text, y.getField("value"))))
            if b.kind == "num":
                told = _apply(op, text.try_cast("double"), y)
            elif b.kind == "bool":
                told = _apply(op, text.try_cast("boolean"), y)
            elif b.kind == "time":
                told = _apply(op, text.try_cast("timestamp_ntz"), y.cast("timestamp_ntz"))
            else:
                told = _apply(op, text, y)
            if op == "!=":
                return F.when(literal, told).otherwise(F.when(x.isNotNull() & y.isNotNull(), F.lit(True)))
            return F.when(literal, told).otherwise(F.when(x.isNotNull() & y.isNotNull(), F.lit(False))) if op == "=" else F.when(literal, told)
        if a.kind == b.kind:
            return _apply(op, x, y)
        if a.kind == "num" and b.kind == "str":
            return _apply(op, x, y.try_cast("double"))
        if a.kind == "bool" and b.kind == "str":
            return _apply(op, x, y.try_cast("boolean"))
        if a.kind == "time" and b.kind == "str":
            return _apply(op, x, y.try_cast(a.term.types[0] if a.term else "timestamp_ntz"))
        return _error()

    def same(self, op: str, a: Val, b: Val) -> Column:
        """Equality where IRIs or blank nodes take part; they have no order."""
        if op not in ("=", "!="):
            return _error()
        there = [v.term for v in (a, b) if v.term is not None]
        if a.term is not None and b.term is not None:
            condition = T.equal(a.term, b.term)
        elif a.const is not None and b.const is not None:
            return F.lit((a.kind, a.const) == (b.kind, b.const)) if op == "=" else F.lit((a.kind, a.const) != (b.kind, b.const))
        elif a.kind == "iri" and b.kind == "iri" and (a.const or b.const) and there:
            condition = T.is_iri(there[0], a.const or b.const)
        elif "mixed" in (a.kind, b.kind):
            m, o = (a, b) if a.kind == "mixed" else (b, a)
            condition = (m.col.getField("value") == o.col) & (m.col.getField("kind") == ("uri" if o.kind == "iri" else "bnode"))
        elif a.kind == b.kind:
            condition = a.col == b.col
        else:
            condition = None
        if condition is None:
            both = a.col.isNotNull() & b.col.isNotNull()
            return F.when(both, F.lit(op == "!="))
        return condition if op == "=" else ~condition

    # functions

    def _bound(self, x) -> Val:
        term = self.terms.get(x.name) if isinstance(x, Var) else None
        return Val("bool", F.lit(False) if term is None else T.bound(term), XSD + "boolean")

    def _str(self, x) -> Val:
        return Val("str", self.text(self.val(x)), XSD + "string")

    def _lang(self, x) -> Val:
        v = self.val(x)
        if v.kind == "mixed":
            return Val("str", F.when(v.col.getField("kind") == "literal", F.coalesce(v.col.getField("lang"), F.lit(""))), XSD + "string")
        if v.kind in ("iri", "bnode", "error"):
            return Val("error", _error("string"))
        return Val("str", F.when(v.col.isNotNull(), F.lit(v.lang or "")), XSD + "string")

    def _langmatches(self, x, y) -> Val:
        tag, wanted = F.lower(self.text(self.val(x))), F.lower(self.text(self.val(y)))
        return Val("bool", F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))), XSD + "boolean")

    def _datatype(self, x) -> Val:
        v = self.val(x)
        rdf_lang = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
        if v.kind == "mixed":
            kind = F.coalesce(v.col.getField("datatype"), F.when(v.col.getField("lang").isNotNull(), F.lit(rdf_lang)), F.lit(XSD + "string"))
            return Val("iri", F.when(v.col.getField("kind") == "literal", kind))
        if v.kind in ("iri", "bnode", "error"):
            return Val("error", _error("string"))
        kind = rdf_lang if v.lang else v.datatype or XSD + {"num": "double", "bool": "boolean", "time": "dateTime"}.get(v.kind, "string")
        return Val("iri", F.when(v.col.isNotNull(), F.lit(kind)))

    def _sameterm(self, x, y) -> Val:
        a, b = self.val(x), self.val(y)
        if "error" in (a.kind, b.kind):
            return Val("error", _error())
        if a.kind in ("iri", "bnode") or b.kind in ("iri", "bnode"):
            return Val("bool", self.same("=", a, b), XSD + "boolean")
        if a.kind == "mixed" and b.kind == "mixed":
            return Val("bool", a.col == b.col if a.term is None else T.equal(a.term, b.term), XSD + "boolean")
        if a.kind != b.kind or (a.lang or "") != (b.lang or "") or a.kind != "mixed" and a.datatype and b.datatype and a.datatype != b.datatype:
            if "mixed" in (a.kind, b.kind):
                return Val("bool", self.compare("=", a, b), XSD + "boolean")
            return Val("bool", F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)), XSD + "boolean")
        return Val("bool", a.col == b.col, XSD + "boolean")

    def _is(self, x, kinds: tuple[str, ...], names: tuple[str, ...]) -> Val:
        v = self.val(x)
        if v.kind == "error":
            return v
        if v.kind == "mixed":
            return Val("bool", v.col.getField("kind").isin(*names), XSD + "boolean")
        return Val("bool", F.when(v.col.isNotNull(), F.lit(v.kind in kinds)), XSD + "boolean")

    def _isiri(self, x) -> Val:
        return self._is(x, ("iri",), ("uri",))

    _isuri = _isiri

    def _isblank(self, x) -> Val:
        return self._is(x, ("bnode",), ("bnode",))

    def _isliteral(self, x) -> Val:
        return self._is(x, ("num", "str", "bool", "time"), ("literal",))

    def _regex(self, x, pattern, flags=None) -> Val:
        """A pattern that is none is an error of the row, never of the job."""
        text, p = self.text(self.val(x)), self.val(pattern)
        f = self.val(flags).const if flags is not None else ""
        if not isinstance(f, str) or set(f) - set("imsx"):
            return Val("error", _error())
        said = f"(?{f})" if f else ""
        if isinstance(p.const, str):
            return Val("bool", text.rlike(said + p.const), XSD + "boolean") if _is_pattern(said + p.const) else Val("error", _error())
        # found anywhere; null where the pattern, which rows hold, is none
        whole = F.concat(F.lit(said + r"[\s\S]*(?:"), self.text(p), F.lit(r")[\s\S]*"))
        return Val("bool", F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), whole, text).cast("boolean"), XSD + "boolean")

    def _contains(self, x, y) -> Val:
        return Val("bool", F.contains(self.text(self.val(x)), self.text(self.val(y))), XSD + "boolean")

    def _ucase(self, x) -> Val:
        v = self.val(x)
        return Val("str", F.upper(self.text(v)), XSD + "string", v.lang)

    _uppercase = _ucase

    def _lcase(self, x) -> Val:
        v = self.val(x)
        return Val("str", F.lower(self.text(v)), XSD + "string", v.lang)

    def cast(self, v: Val, to: str) -> Val:
        """xsd:to(v); NULL where the text or the range does not fit."""
        c = self.shown(v) if v.kind != "error" else _error("string")
        if v.kind == "mixed":
            c = F.when(v.col.getField("kind") == "literal", c) if to != "string" else c
        if v.kind in ("iri", "bnode") and to != "string":
            return Val("error", _error("string"))
        if to == "string":
            return Val("str", c.cast("string"), XSD + "string")
        if to == "boolean":
            return Val("bool", c.try_cast("boolean"), XSD + to)
        if to in ("double", "float"):
            return Val("num", c.try_cast(to), XSD + to)
        if to == "decimal":
            return Val("num", c.try_cast("decimal(38,18)"), XSD + to)
        if to == "dateTime":
            return Val("time", c.try_cast("timestamp_ntz"), XSD + to)
        if to in _RANGES:
            low, high = _RANGES[to]
            n = c.try_cast("decimal(38,0)") if to == "unsignedLong" else c.try_cast("bigint")
            inside = F.lit(True)
            if low is not None and low > -(2**63):
                inside = inside & (n >= low)
            if high is not None and high < 2**63 - 1 or to == "unsignedLong":
                inside = inside & (n <= F.lit(Decimal(high)) if to == "unsignedLong" else n <= high)
            return Val("num", F.when(inside, n), XSD + to)
        return Val("error", _error("string"))


def _is_pattern(text: str) -> bool:
    """Whether Java's regular expressions take it."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(text)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def _apply(op: str, x: Column, y: Column) -> Column:
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
