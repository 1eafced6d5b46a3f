"""The weak-label model against a plain evaluation document by document."""

import math
import random

from semlake.llm import quality


def plain_em(docs, prior, rounds):
    """Maximum a posteriori by expectation-maximisation over a list of vote patterns: (shares of classes, rates[labeller][vote][class])."""
    k, classes = len(docs[0]), range(len(prior.shares))
    more = [[[float(prior.counts[j, v, c]) for c in classes] for v in range(3)] for j in range(k)]
    shares, n = [float(x) for x in prior.shares], len(docs)
    rates = [[[more[j][v][c] / sum(more[j][x][c] for x in range(3)) for c in classes] for v in range(3)] for j in range(k)]
    for _ in range(rounds):
        of = []
        for d in docs:
            w = [shares[c] * math.prod(rates[j]["-+0".index(v)][c] for j, v in enumerate(d)) for c in classes]
            of.append([x / sum(w) for x in w])
        shares = [(sum(w[c] for w in of) + float(prior.shares[c])) / (n + 1) for c in classes]
        for j in range(k):
            for c in classes:
                counts = [more[j][v][c] + sum(w[c] for w, d in zip(of, docs) if d[j] == "-+0"[v]) for v in range(3)]
                for v in range(3):
                    rates[j][v][c] = counts[v] / sum(counts)
    return shares, rates


def drawn(rng, n, labellers, annotated):
    out = []
    for _ in range(n):
        bad = rng.random() < 0.2
        votes = "".join("-" if rng.random() < (a if bad else b) else "0" for a, b in labellers)
        out.append(votes + ("0" if rng.random() > annotated else "-" if bad != (rng.random() < 0.02) else "+"))
    return out


def counted(docs):
    patterns = {}
    for d in docs:
        patterns[d] = patterns.get(d, 0) + 1
    return patterns


def test_same_as_document_by_document():
    docs = drawn(random.Random(1), 300, [(0.6, 0.02), (0.3, 0.01), (0.5, 0.2)], 0.2)
    patterns = counted(docs)
    found = quality.estimate(patterns, quality.anchors(patterns), rounds=20)
    shares, rates = plain_em(docs, quality.anchors(patterns), 20)
    assert max(abs(a - b) for a, b in zip(found.shares, shares)) < 1e-6
    assert max(abs(found.table[j, v, c] - rates[j][v][c]) for j in range(4) for v in range(3) for c in range(4)) < 1e-6
    for p in patterns:
        w = [shares[c] * math.prod(rates[j]["-+0".index(v)][c] for j, v in enumerate(p)) for c in range(4)]
        assert abs(found.bad(p) - (1 - w[0] / sum(w))) < 1e-6


def test_rates_are_estimated():
    """Kinds of bad texts that one labeller each sees are told from good ones, and labellers of different accuracy apart, at any size."""
    for n in (4000, 40_000):
        rng = random.Random(n)
        docs, truth = [], []
        for _ in range(n):
            kind = rng.choices((-1, 0, 1, 2), (0.85, 0.07, 0.05, 0.03))[0]
            votes = "".join("-" if rng.random() < ((0.95, 0.8, 0.9)[j] if kind == j else (0.002, 0.01, 0.06)[j]) else "0" for j in range(3))
            bad = kind >= 0
            docs.append(votes + ("0" if rng.random() > 0.1 else "-" if bad != (rng.random() < 0.01) else "+"))
            truth.append(bad)
        patterns = counted(docs)
        found = quality.estimate(patterns, quality.anchors(patterns))
        share, rates = found
        assert abs(share - 0.15) < 0.03
        assert all(abs(rates[j]["-"][1] - x) < 0.02 for j, x in enumerate((0.002, 0.01, 0.06)))
        lone = [found.bad("".join("-" if i == j else "0" for i in range(3)) + "0") for j in range(3)]
        assert lone[0] > 0.9 and lone[0] > lone[1] > lone[2] and found.bad("0000") < 0.05
        # nearly as many right as with the rates that the votes were drawn from
        best = 0
        for d, t in zip(docs, truth):
            good = 0.85 * math.prod(x if v == "-" else 1 - x for v, x in zip(d, (0.002, 0.01, 0.06))) * {"-": 0.01, "+": 0.99, "0": 1}[d[3]]
            bad = sum(w * math.prod(x if v == "-" else 1 - x for v, x in zip(d, [(0.95, 0.8, 0.9)[j] if j == kind else (0.002, 0.01, 0.06)[j] for j in range(3)])) for kind, w in enumerate((0.07, 0.05, 0.03))) * {"-": 0.99, "+": 0.01, "0": 1}[d[3]]
            best += (bad > good) == t
        assert sum((found.bad(d) > 0.5) == t for d, t in zip(docs, truth)) >= best - 0.01 * n


def test_lexicons_vote_on_the_other_half(spark):
    rows = [(i, f"{'plain words here' if i % 3 else 'venomword talk'} n{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("doc_id", "text").alias("at"), "text")
    judged = {r["at"]: r["doc"] % 3 == 0 for r in keyed.collect()}
    halves = quality._lexicons(keyed, judged)
    assert all(b"venomword" in words and b"plain" not in words and b"venomw" in starts for words, starts in halves)
    for half, (words, _) in enumerate(halves):  # words of one text of the own half only are never known
        own = {f"n{r['doc']}".encode() for r in keyed.collect() if r["at"] & 1 == half}
        assert not words & own


def test_fit_starts_no_workers_for_lists(spark, monkeypatch):
    """Executors would keep workers of a second kind beside those of the texts."""
    texts = ["you are all gruesome wretches", "a quiet morning by the lake", "###### %%%% $$$$ @@@@ ^^^^"]
    docs = spark.createDataFrame([(i, f"{texts[i % 3]} {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 < 2), int(i % 3 == 0)) for i in range(45)], "doc_id long, quality int, toxic int")
    made = []
    whole = type(spark.sparkContext).parallelize
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda self, *a, **b: made.append(1) or whole(self, *a, **b))
    scorer = quality.fit(docs, labels)
    assert made == []
    assert scorer(b"you are all gruesome wretches 60")[1] > 0 > scorer(b"a quiet morning by the lake 60")[1]
