"""Nested references: ``a.b``, ``a/b``, ``arr[*]/x``, ``arr[*][@k=v]/x``, and paths into JSON text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r"(?P<name>@?[^\[\]/.]+)(?P<each>\[\*\])?(?:\[@?(?P<key>[^=!\]]+?)\s*(?P<op>!?=)\s*['\"]?(?P<value>[^\]'\"]*)['\"]?\])?")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _field(kind, name: str):
    """The field's name as the struct has it: attributes of XML elements begin with an underscore."""
    names = kind.fieldNames()
    for tried in (name.lstrip("@"), "_" + name.lstrip("@")):
        if tried in names:
            return tried
    return None


def many(df: DataFrame, reference: str) -> bool:
    """Whether ``reach`` makes several rows of one, or drops some: arrays or conditions are on the way."""
    if reference in df.columns:
        return False
    steps = list(_STEP.finditer(reference.lstrip("$./")))
    name = _field(df.schema, steps[0]["name"]) if steps else None
    kind = df.schema[name].dataType if name else None
    for i, step in enumerate(steps):
        if i and isinstance(kind, T.StringType):
            return False  # a path into JSON text gives one text
        if i and isinstance(kind, T.MapType):
            kind = kind.valueType
        elif i:
            field = _field(kind, step["name"]) if isinstance(kind, T.StructType) else None
            kind = kind[field].dataType if field else None
        if step["each"] or step["key"] or isinstance(kind, T.ArrayType):
            return True
    return False


def reach(df: DataFrame, reference: str, out: str) -> tuple[DataFrame, T.DataType]:
    """``df`` with column ``out`` of what the reference leads to, and its type.

    Arrays on the way are exploded, one row an element (none: null); a
    condition on an element drops the others. A column of this very name is
    taken as it is. A text column with steps after it is read as JSON.
    """
    if reference in df.columns:
        return df.withColumn(out, quoted(reference)), df.schema[reference].dataType
    steps = [m for m in _STEP.finditer(reference.lstrip("$./"))]
    if not steps:
        raise ValueError(f"{reference!r} is no reference")
    name = _field(df.schema, steps[0]["name"])
    if name is None:
        raise ValueError(f"no column {steps[0]['name']!r} for reference {reference!r}; there are {', '.join(df.columns)}")
    df, kind = df.withColumn(out, quoted(name)), df.schema[name].dataType
    for i, step in enumerate(steps):
        if i:
            if isinstance(kind, T.StringType):
                rest = ".".join(s["name"] + (s["each"] or "") for s in steps[i:])
                return df.withColumn(out, F.get_json_object(quoted(out), "$." + rest)), kind
            if isinstance(kind, T.ArrayType):
                df, kind = df.withColumn(out, F.explode_outer(quoted(out))), kind.elementType
            if isinstance(kind, T.MapType):
                df, kind = df.withColumn(out, F.element_at(quoted(out), step["name"])), kind.valueType
            else:
                field = _field(kind, step["name"]) if isinstance(kind, T.StructType) else None
                if field is None:
                    raise ValueError(f"no field {step['name']!r} for reference {reference!r}")
                df, kind = df.withColumn(out, quoted(out).getField(field)), kind[field].dataType
        if step["each"] and isinstance(kind, T.ArrayType):
            df, kind = df.withColumn(out, F.explode_outer(quoted(out))), kind.elementType
        if step["key"] and isinstance(kind, T.StructType):
            key = _field(kind, step["key"])
            equal = quoted(out).getField(key).cast("string") == step["value"]
            df = df.where(equal if step["op"] == "=" else ~equal)
    if isinstance(kind, T.ArrayType):
        df, kind = df.withColumn(out, F.explode_outer(quoted(out))), kind.elementType
    if isinstance(kind, T.StructType) and "_VALUE" in kind.fieldNames():  # an XML element with attributes
        df, kind = df.withColumn(out, quoted(out).getField("_VALUE")), kind["_VALUE"].dataType
    return df, kind
