"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Patterns yield candidates with their places. Each candidate's value is hashed,
and the hashes are counted over the corpus by distinct owners and repositories.
What many owners have, or one owner in many repositories, is a copied example; what one owner has in few of them,
and what looks like a credential rather than a placeholder, is reported as ``live`` besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import col, table, written

# The patterns of the candidates, the group that holds the value, the shortest that counts.
# The runs of the last two kinds have their shortest length in the pattern: a run is taken whole from its start,
# so a shorter one never hides a longer. An assignment that fails does hide what it spans, so its length is looked at later.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
PLACEHOLDER = r"(?i:example|changeme|placeholder|dummy|sample|your|xxxx|0123456|123456|abcdef)"
#: A value of fewer different characters is taken for a placeholder.
DIFFERENT = 6
#: Owners, and repositories of all owners, that a live value has at most.
OWNERS, REPOSITORIES = 1, 2


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Of each match: the characters between it and the match before, its length, its value."""
    gaps, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    each = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value")),
        lambda m: F.struct(F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("len"), F.length(m["value"]).alias("vlen"), F.sha2(m["value"], 256).alias("hash"), _live(m["value"]).alias("live")),
    )
    return F.when(text.rlike(pattern), each)


def _live(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT) & ~value.rlike(PLACEHOLDER)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: Column | None = None, owner_col: Column | None = None, most_owners: int = OWNERS, most_repos: int = REPOSITORIES) -> DataFrame:
    """For each row of ``docs``: its id, n_assign, n_access, n_hex, n_live,
    n_example (long), base (string of kind:start:end, comma-joined, by start and
    then kind), spans (the same with ``live`` spans after equal starts).

    Starts and ends are code points, the end exclusive. ``owner_col`` says who has
    a row (default: column source) and ``repo_col`` which of the owner's
    repositories it is in (default: column lang); null is an owner and a repository
    of its own, other than an empty one. A candidate is live if at most ``most_owners`` owners have its value in at most
    ``most_repos`` repositories, and it does not look like a placeholder; n_example counts the others.

    Null texts are empty; texts without candidates have zeros and empty strings.
    Repeated rows each get a row. Very long texts are matched whole; a
    document's matches are laid out as rows, so many of them cost no more than
    their number. Other columns are not looked at.
    """
    told_of = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    owner = told_of(owner_col if owner_col is not None else col("source"))
    repo = told_of(repo_col if repo_col is not None else col("lang"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("doc"), owner.alias("owner"), repo.alias("repo"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = written(rows.select("row", "doc", "owner", "repo", *[_matches(F.col("text"), pattern, group).alias(kind) for kind, (pattern, group, _) in KINDS.items()]), "matches")

    parts = [rows.where(F.col(kind).isNotNull()).select("row", "owner", "repo", F.lit(i).alias("k"), F.lit(kind).alias("kind"), F.lit(KINDS[kind][2]).alias("least"), F.posexplode(kind).alias("i", "m")) for i, kind in enumerate(KINDS)]
    spans = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # where a match ends: all gaps and matches up to it
    upto = Window.partitionBy("row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(upto)).where(F.col("m.vlen") >= F.col("least"))
    spans = written(spans.select("row", "owner", "repo", "k", "kind", (F.col("end") - F.col("m.len")).alias("start"), "end", "m.hash", "m.live"), "spans")

    # pairs first, so that a value that very many rows have is counted in parts
    owners = spans.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    owners = written(owners, "owners")
    judged = spans.join(owners, "hash").withColumn("live", F.col("live") & (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos))
    base = F.struct("start", "k", "end", "kind")
    per_row = judged.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}") for kind in KINDS],
        F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_example"),
        F.sort_array(F.collect_list(base)).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("live"), F.struct("start", F.lit(len(KINDS)).alias("k"), "end", F.lit("live").alias("kind"))))).alias("more"),
    )

    def told(spans: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))

    out = rows.select("row", "doc").join(per_row, "row", "left")
    counts = [f"n_{kind}" for kind in KINDS] + ["n_live", "n_example"]
    return out.select(
        F.col("doc").alias(id_col), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        told(F.col("base")).alias("base"), told(F.sort_array(F.concat("base", "more"))).alias("spans"),
    )


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_example")


_ASSIGN_SQL = r"""(([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))"""
OP3_SQL = rf"""
with d as (select doc_id, coalesce(text, '') t, coalesce('=' || source, '') owner, coalesce('=' || lang, '') repo from documents),
m as (
  select doc_id, owner, repo, 0 k, 'assign' kind, 6 least, regexp_extract_all(t, '{_ASSIGN_SQL}', 1) w, regexp_extract_all(t, '{_ASSIGN_SQL}', 3) v, regexp_split_to_array(t, '{_ASSIGN_SQL}') g from d
  union all select doc_id, owner, repo, 1, 'access', 20, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') from d
  union all select doc_id, owner, repo, 2, 'hex', 24, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_split_to_array(t, '[0-9a-f]+') from d),
u as (select doc_id, owner, repo, k, kind, least, unnest(range(1, len(w) + 1)) i, w, v, g from m where len(w) > 0),
x as (select doc_id, owner, repo, k, kind, least, i, length(w[i]) n, v[i] v, length(g[i]) gap from u),
s as (select *, cast(sum(gap + n) over (partition by doc_id, k order by i) as bigint) e from x),
b as (select doc_id, owner, repo, k, kind, e - n st, e, v from s where length(v) >= least),
o as (select v, count(distinct owner) owners, count(distinct owner || ' ' || repo) repos from b group by v),
j as (select b.*, owners <= {OWNERS} and repos <= {REPOSITORIES} and len(list_distinct(string_split(b.v, ''))) >= {DIFFERENT}
        and not regexp_matches(lower(b.v), 'example|changeme|placeholder|dummy|sample|your|xxxx|0123456|123456|abcdef') live from b join o using (v)),
a as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
        count(*) filter (live) n_live, count(*) filter (not live) n_example, string_agg(kind || ':' || st || ':' || e, ',' order by st, k) base from j group by doc_id),
f as (select doc_id, string_agg(kind || ':' || st || ':' || e, ',' order by st, k, e) spans
      from (select doc_id, k, kind, st, e from j union all select doc_id, 3, 'live', st, e from j where live) group by doc_id)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256,
  coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example
from d left join a using (doc_id) left join f using (doc_id)
"""
