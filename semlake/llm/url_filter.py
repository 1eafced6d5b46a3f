"""URL filters: rules by host and path, and gradient-boosted trees for the rest.

The rules label the urls they fit. Trees on lexical features (lengths, depth,
digit ratio, entropy, parameter counts, and the block rate of the host's
suffix among all other labelled urls) are trained from these and judge the urls that
no rule fits. The fitted trees become one Column expression, so that judging
stays a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import by_hash, col, table, written

#: (verdict, host, path prefix): fixed values of the query's contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Labelled urls that the trees are fitted on at most: those of the smallest hash.
SAMPLE = 20_000
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "fragment", "hyphens", "suffix_n", "suffix_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://``, A-Z lower-cased, and the path after it; both empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _fitting(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(at + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    return F.when(n > 0, F.aggregate(F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n))).otherwise(0.0)


def _features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    def count(c: Column, part: str) -> Column:
        return (F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / F.lit(len(part))

    n = F.length(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": n, "host_length": F.length(host), "path_length": F.length(path), "depth": count(path, "/"), "labels": count(host, ".") + 1,
        "digits": F.when(n > 0, (n - F.length(F.regexp_replace(url, "[0-9]", ""))) / n).otherwise(0.0), "entropy": _entropy(host),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1), "fragment": F.when(F.instr(url, "#") > 0, 1).otherwise(0), "hyphens": count(host, "-") + count(path, "-"),
    }


@dataclass(frozen=True)
class Trees:
    """Additive trees: each is nested (feature, threshold, left, right) down to a value; left if value <= threshold."""

    names: tuple[str, ...]
    start: float
    trees: tuple

    def score(self, value) -> Column:
        def of(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(value(self.names[feature]) <= float(threshold), of(left)).otherwise(of(right))

        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + of(tree)
        return total


def fit(x, y, names=FEATURES, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 5) -> Trees:
    """Gradient boosting on logistic loss with Newton steps over quantile bins."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # <= cut is its bin
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    score, trees = np.full(len(y), start), []

    def grow(rows, grad, hess, left):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = -g / (h + 1.0) * rate
        best, at = 1e-6, None
        if left and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best + 1e-9:
                    best, at = gain[k], (j, k)
        if at is None:
            score[rows] += leaf
            return float(leaf)
        j, k = at
        low = binned[rows, j] <= k
        return (j, float(cuts[j][k]), grow(rows[low], grad, hess, left - 1), grow(rows[~low], grad, hess, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
    return Trees(tuple(names), start, tuple(trees))


def described(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page, host, path, rule, said, at, suffix, and ``FEATURES``): each row's parts, the rule that fits it and what that says, and its lexical features.

    The suffix statistics are over the urls of ``labelled`` (default: these rows) that a rule fits, a url's own label left out.
    """

    def parts(pages: DataFrame) -> DataFrame:
        rows = pages.select(col(id_col).alias("page"), F.coalesce(col(url_col), F.lit("")).alias("url"))
        host, path = host_and_path(F.col("url"))
        rule, said = _fitting(F.col("host"), F.col("path"), rules)
        rows = rows.select("page", "url", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), said.alias("said"))
        return rows.select("page", "host", "path", "rule", "said", F.xxhash64("url", "page").alias("at"), F.element_at(F.split("host", r"\."), -1).alias("suffix"), *[c.cast("double").alias(k) for k, c in _features(F.col("url"), F.col("host"), F.col("path")).items()])

    rows = written(parts(pages), "urls")
    known = rows if labelled is None else parts(labelled)
    block = F.when(F.col("said") == "block", 1.0).otherwise(0.0)
    suffixes = known.where(F.col("said").isNotNull()).groupBy("suffix").agg(F.count(F.lit(1)).cast("double").alias("suffix_n"), F.sum(block).alias("blocked"))
    suffixes = written(suffixes, "suffixes")
    own = F.when(F.col("said").isNull(), 0.0).otherwise(1.0) if labelled is None else F.lit(0.0)
    others = F.coalesce(F.col("suffix_n") - own, F.lit(0.0))
    rate = (F.coalesce(F.col("blocked") - own * block, F.lit(0.0)) + 1) / (others + 2)
    return rows.join(suffixes, "suffix", "left").withColumn("suffix_rate", rate).withColumn("suffix_n", others).drop("blocked")


def learned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE, rows: DataFrame | None = None) -> Trees | None:
    """Trees for the urls that a rule fits: at most ``sample`` of them, by hash. None without any. ``rows`` are these pages, described already."""
    rows = described(pages, id_col, url_col, rules) if rows is None else rows
    block = F.when(F.col("said") == "block", 1.0).otherwise(0.0)
    labelled = by_hash(rows.where(F.col("said").isNotNull()).select("at", *FEATURES, block.alias("block")), "at", sample)
    return fit([[r[f] for f in FEATURES] for r in labelled], [r["block"] for r in labelled]) if labelled else None


def scored(pages: DataFrame, trees: Trees | None, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(``id_col``, score): log-odds of block by the trees alone, for pages other than the ``labelled`` ones that they were learned from."""
    rows = described(pages, id_col, url_col, rules, labelled)
    return rows.select(F.col("page").alias(id_col), (trees.score(F.col) if trees else F.lit(0.0)).alias("score"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """For each row: its id, host, path, rule (or null), verdict (allow or block), score (log-odds of block).

    Rules label the urls they fit; the trees are fitted on at most ``sample`` of
    these, by hash, while the suffix statistics count all of them. A url
    without ``://`` and a null url have empty host and path and fit no rule. With
    no labelled url, or labels of one kind only, the score is that of the label's
    rate (0, which allows, if there is none). Repeated rows each get a row; long
    urls are judged whole; other columns are not looked at.
    """
    rows = described(pages, id_col, url_col, rules)
    trees = learned(pages, id_col, url_col, rules, sample, rows)
    score = trees.score(F.col) if trees else F.lit(0.0)
    verdict = F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.withColumn("score", score).select(F.col("page").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
