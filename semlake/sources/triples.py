"""Triple tables: one row for each triple."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang")
# possessive throughout: the matcher keeps no state for each character of a literal
_LINE = r'^\s*+(<[^>]*+>|_:[^\s<>"]++)\s*+<([^>]*+)>\s*+(<[^>]*+>|_:[^\s<>"]*[^\s<>".]|"[^"\\]*+(?:\\.[^"\\]*+)*+")(?:@([A-Za-z0-9\-]++)|\^\^<([^>]*+)>)?+\s*+\.\s*+(?:#.*+)?+$'
_NONE = r"^\s*+(?:#.*+)?+$"
_TOKEN = r"\\U[0-9A-Fa-f]{8}|(?:\\u[0-9A-Fa-f]{4})++|(?s:\\.)|[^\\]++"
# The escapes of one letter.
_LETTERS = (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f"))


def _unescaped(c: Column) -> Column:
    """Text with its escapes replaced, in literals and IRIs."""

    def one(x: Column) -> Column:
        letter = F.substr(x, F.lit(2))
        out = letter
        for name, means in _LETTERS:
            out = F.when(letter == name, F.lit(means)).otherwise(out)
        short = F.decode(F.unhex(F.replace(x, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        long = F.decode(F.unhex(F.substr(x, F.lit(3))), "UTF-32")
        return F.when(~x.startswith("\\"), x).when((F.length(x) == 10) & x.startswith("\\U"), long).when((F.length(x) > 2) & x.startswith("\\u"), short).otherwise(out)

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)), one), "")).otherwise(c)


def read_ntriples(spark: SparkSession, path: str, malformed: str = "fail") -> DataFrame:
    """N-Triples text as a triple table; comments and blank lines are left out.

    A line that is no triple fails the job and is named, unless ``malformed`` is "drop".
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(_NONE))
    fits = F.col("value").rlike(_LINE)
    lines = lines.where(fits) if malformed == "drop" else lines.where(F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("no triple: "), F.substr("value", F.lit(1), F.lit(200)))).cast("boolean")))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    lines = lines.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), part(4).alias("lang"), part(5).alias("datatype"))
    s, o = F.col("s"), F.col("o")

    def bare(c):
        return F.when(c.startswith("_:"), F.substr(c, F.lit(3))).otherwise(_unescaped(F.substr(c, F.lit(2), F.length(c) - 2)))

    return lines.select(
        bare(s).alias("s"), F.when(s.startswith("_:"), "bnode").otherwise("uri").alias("s_kind"), _unescaped(F.col("p")).alias("p"), bare(o).alias("o"),
        F.when(o.startswith('"'), "literal").when(o.startswith("_:"), "bnode").otherwise("uri").alias("o_kind"),
        F.nullif(F.col("datatype"), F.lit("")).alias("o_datatype"), F.nullif(F.lower("lang"), F.lit("")).alias("o_lang"),
    )


def _iri(c: Column) -> Column:
    """An IRI in its brackets; characters that may not stand there are escaped."""
    bad = r'[\x00-\x20<>"{}|^`\\]'
    parts = F.transform(F.regexp_extract_all(c, F.lit(rf'{bad}|[^\x00-\x20<>"{{}}|^`\\]++'), F.lit(0)), lambda x: F.when(x.rlike(f"^{bad}$"), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(x)), 4, "0"))).otherwise(x))
    return F.concat(F.lit("<"), F.when(c.rlike(bad), F.array_join(parts, "")).otherwise(c), F.lit(">"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """A frame (s, p, o [, o_kind, o_datatype, o_lang, s_kind]) as N-Triples text. A language goes before a datatype."""
    have = set(triples.columns)
    kind = F.col("o_kind") if "o_kind" in have else F.when(F.col("o").rlike("^[a-z]+://"), "uri").otherwise("literal")
    escaped = F.col("o")
    for raw, said in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(said))
    tail = F.lit("")
    if "o_datatype" in have:
        tail = F.when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^"), _iri(F.col("o_datatype")))).otherwise(tail)
    if "o_lang" in have:
        tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).otherwise(tail)
    s = _iri(F.col("s"))
    if "s_kind" in have:
        s = F.when(F.col("s_kind") == "bnode", F.concat(F.lit("_:"), "s")).otherwise(s)
    o = F.when(kind == "uri", _iri(F.col("o"))).when(kind == "bnode", F.concat(F.lit("_:"), "o")).otherwise(F.concat(F.lit('"'), escaped, F.lit('"'), tail))
    triples.select(F.concat_ws(" ", s, _iri(F.col("p")), o, F.lit(".")).alias("value")).write.text(path)


def triple_frame(spark: SparkSession, triples) -> DataFrame:
    """A triple table of parsed Turtle triples."""
    rows = [(s[1], s[0], p, o[1], o[0], o[2], o[3]) for s, p, o in triples]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))
