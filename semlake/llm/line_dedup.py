"""Line dedup by overlapping three-line windows, in DataFrame operations only.

Every run of ``window`` consecutive lines is hashed to 128 bits. A window that
occurs more than once keeps its first occurrence (smallest document id, then
smallest line); the lines that its later occurrences cover are merged per
document and removed. A line is removed only if an equal line stands earlier
in the order, so every distinct line of the corpus stays at least once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, fresh, keys, table, written


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, stats: bool = False) -> DataFrame:
    """``docs`` with the later occurrences of repeated line windows taken out.

    Lines end at ``\\n``; the remaining lines are joined by it again. With
    ``stats`` the frame also gets ``n_lines`` and ``n_removed`` (long), which
    replace columns of these names.

    Null text stays null, has no lines and none removed; an empty text is one
    empty line. Texts of fewer lines than a window are never changed, nor do
    windows of blank lines only count. A null id comes after all others; equal
    ids are ordered by a hash of id and text. Rows repeated in id and text are one
    document stated several times: all get the same text. Other columns pass
    through, whatever their names.
    """
    k1, k2, gone, lines, kept = fresh(docs, "k1", "k2", "gone", "lines", "kept")
    doc, text = col(id_col), col(text_col)
    key1, key2 = keys(doc, text)
    rows = docs.select(doc.alias("doc"), key1.alias("a"), key2.alias("b"), F.split(text, "\n", -1).alias("lines")).where(F.size("lines") >= window)
    each = F.posexplode(F.slice("lines", 1, F.size("lines") - (window - 1)))
    rows = rows.select("doc", "a", "b", "lines", each.alias("pos", "line"))
    span = F.slice("lines", F.col("pos") + 1, F.lit(window))
    h1, h2 = keys(span)
    blank = F.trim(F.regexp_replace(F.array_join(span, ""), r"\s+", "")) == ""
    windows = written(rows.where(~blank).select("doc", "a", "b", "pos", h1.alias("h1"), h2.alias("h2")), "windows")

    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "a", "b", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    repeated = written(repeated, "repeated")
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = written(later.groupBy("a", "b").agg(F.collect_set("pos").alias("starts")), "covered")
    covered = covered.select(F.col("a").alias(k1), F.col("b").alias(k2), F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (window - 1))))).alias(gone))

    # sorted and merged: neither side has a bound, and both can spill
    out = docs.withColumn(k1, key1).withColumn(k2, key2).join(covered.hint("merge"), [k1, k2], "left")
    out = out.withColumn(lines, F.when(col(gone).isNotNull(), F.split(text, "\n", -1)))
    staying = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), col(gone))
    stay = F.transform(staying, lambda i: F.element_at(col(lines), i + 1))
    out = out.withColumn(kept, F.when(col(gone).isNotNull(), F.array_join(stay, "\n")).otherwise(text))
    extra = []
    if stats:
        total = F.when(text.isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
        removed = F.when(col(gone).isNull(), F.lit(0)).otherwise(F.size(gone))
        extra = [total.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed")]
    passed = [col(kept).alias(c) if c == text_col else col(c) for c in docs.columns if not (stats and c.lower() in ("n_lines", "n_removed"))]
    return out.select(*passed, *extra)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), stats=True).select("doc_id", "n_lines", "n_removed", "text")


OP10_SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) ls from documents),
w as (select doc_id, unnest(range(1, len(ls) - 1)) p, ls from d where len(ls) >= 3),
v as (select doc_id, p, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] t from w),
o as (select doc_id, p, row_number() over (partition by t order by doc_id, p) r from v where regexp_replace(t, '\s+', '', 'g') <> ''),
g as (select distinct doc_id, unnest([p, p + 1, p + 2]) p from o where r > 1),
l as (select doc_id, unnest(ls) line, unnest(range(1, len(ls) + 1)) p from d),
k as (select l.doc_id, count(*) n_lines, count(g.p) n_removed, coalesce(string_agg(case when g.p is null then l.line end, chr(10) order by l.p), '') text
      from l left join g on g.doc_id = l.doc_id and g.p = l.p group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0) n_lines, coalesce(k.n_removed, 0) n_removed, case when d.text is null then null else k.text end text
from d left join k using (doc_id)
"""
