"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Labellers vote bad (-), good (+) or abstain (0) on two questions, whether a text is
junk and whether it is toxic. Bad texts are of several kinds, one that each heuristic labeller is made for, so a labeller may be
silent on texts that are bad in another way. Expectation-maximisation over the counts of vote
patterns estimates how each labeller votes on each kind and on good texts, and how
common they are; labellers err independently given the kind. What a labeller does on
texts that are annotated as good is the prior of its rates there and weighs as much as all texts together, and the annotator is a labeller with an
error rate of its own; no rate is bounded. Two labellers of toxic texts, of whatever
language, are learned: words, and word starts, that annotated toxic texts have and others
have not, each learned on one half of the texts and voting on the other. The posterior
labels of a bounded sample of documents train two linear scorers over hashed
words, word starts and shapes, which judge every document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_hash, col, keys, local_frame, map_texts, table, written

BITS = 17
#: Bytes of a word's start that is a feature besides the word.
PREFIX = 6
#: Documents that the scorers are trained on at most: annotated ones first, by hash. All documents count for the labellers.
SAMPLE = 16_000
#: Before anything is known: the annotator's share of wrong votes; how often a heuristic votes on the kind of bad texts it is
#: made for, on other kinds, and on good texts; how many texts each of the first two counts for; and the share of bad texts.
WRONG, OWN, OTHER, GOOD, FEW, BAD = 0.01, 0.9, 0.1, 0.005, 20, 0.1
#: Bytes of features that are trained on at most.
FEATURE_BYTES = 256 << 20
#: Entries of a learned lexicon at most, texts that must have one, and the share of these that are toxic at least.
LEXICON, LEAST_TEXTS, TELLING = 4000, 4, 0.9
EPOCHS = 4
#: Words of a window in which different words are counted, so that long texts are judged as short ones are.
WINDOW = 400
AXES = ("junk", "toxic")
JUNK = ("symbols", "shouting", "one word", "marks", "letters", "repeats", "runs", "annotator")
TOXIC = ("insults", "words", "starts", "annotator")
# Common English insults.
INSULTS = frozenset(
    b"asshole bastard bastards bitch clown clowns disgusting dumb filth fool fools hate idiot idiots idiotic imbecile liar loser losers moron morons moronic "
    b"pathetic retard scum stupid trash ugly vermin worthless".split()
)
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~"
_STRIP = bytes(b for b in range(128) if not chr(b).isalnum())


def shapes(text: bytes) -> dict:
    """What the labellers and the scorers look at, of a whole text."""
    from collections import Counter
    from operator import eq

    words = text.split()
    n = max(len(words), 1)
    size = max(len(text), 1)
    letters = size - len(text.translate(None, _LETTERS))
    counts = Counter(words)
    return {
        "n": len(words), "words": counts,
        "symbols": (len(text) - len(text.translate(None, _SYMBOLS))) / n,
        "upper": (len(text) - len(text.translate(None, _UPPER))) / max(letters, 1),
        "marks": (text.count(b"!") + text.count(b"?")) / n,
        "top": max(counts.values(), default=0) / n,
        "distinct": len(counts) / n,
        "fresh": (len(counts) if n <= WINDOW else sum(len(set(words[i : i + WINDOW])) for i in range(0, n, WINDOW))) / n,
        "runs": sum(map(eq, words, words[1:])) / n,
        "letters": letters / size,
        "length": size / n,
    }


def lowered(counts) -> set:
    """The different words, in lower case and without the marks around them."""
    return set(b" ".join(counts).lower().translate(_TO_BLANK).split())


_TO_BLANK = bytes(32 if b in _STRIP else b for b in range(256))


def signs(s: dict) -> tuple[bool, ...]:
    """Which signs of junk a text's shape has, one for each labeller of them."""
    enough = s["n"] >= 10
    return (s["symbols"] >= 0.5, enough and s["upper"] >= 0.5, enough and s["top"] >= 0.4, s["marks"] >= 0.4, enough and s["letters"] <= 0.55, s["fresh"] < 0.3, enough and s["runs"] >= 0.04)


def starts_of(words: set) -> set:
    """The first ``PREFIX`` bytes of longer words, as compounds and inflected forms share them."""
    return {w[:PREFIX] for w in words if len(w) > PREFIX}


def votes(text: bytes, shape: dict | None = None, lexicons: tuple = (frozenset(), frozenset())) -> tuple[str, str]:
    """The labellers' votes on junk and on toxic, without the annotators'; a text without words gets no vote.

    ``lexicons`` are the words and the word starts that tell toxic texts.
    """
    s = shape or shapes(text)
    if not s["n"]:
        return "0" * (len(JUNK) - 1), "0" * (len(TOXIC) - 1)
    junk = "".join("-" if x else "0" for x in signs(s))
    words = lowered(s["words"])
    toxic = "".join("-" if x else "0" for x in (words & INSULTS, len(words & lexicons[0]) > 1, starts_of(words) & lexicons[1]))
    return junk, toxic


def buckets(text: bytes, shape: dict | None = None):
    """The different hashed features of a text: words, and its shape in steps."""
    from zlib import crc32

    import numpy as np

    s = shape or shapes(text)
    size = min(s["n"].bit_length(), 10)
    told = [b"=%s:%d" % (k.encode(), min(int(s[k] * 10), 20)) for k in ("symbols", "upper", "marks")] + [b"=runs:%d" % min(int(s["runs"] * 50), 20)]
    told += [b"=%s:%d:%d" % (k.encode(), min(int(s[k] * 10), 20), size) for k in ("top", "distinct", "letters")]
    told += [b"=sign:%d" % i for i, x in enumerate(signs(s)) if x]
    words = lowered(s["words"])
    if words & INSULTS:
        told.append(b"=insult")
    starts = {b"^" + w for w in starts_of(words)}
    found = [*map(crc32, words), *map(crc32, starts), *map(crc32, told)]
    return np.unique(np.fromiter(found, np.int64, len(found)) & ((1 << BITS) - 1)).astype(np.int32)


@dataclass(frozen=True)
class Prior:
    """Where expectation-maximisation begins and what it goes by: pseudo-counts [labeller, vote, class] and shares of the classes, the first of which is good."""

    counts: object
    shares: object


VOTES = "-+0"


def plain_prior(labellers: int) -> Prior:
    """Of labellers of whom nothing is known: one kind of bad texts, on which they vote bad far more often than on good ones."""
    import numpy as np

    start = np.array([[0.01, 0.5], [0.6, 0.1], [0.39, 0.4]])
    return Prior(np.tile(start, (labellers, 1, 1)).reshape(labellers, 3, 2), np.array([1 - BAD, BAD]))


def anchors(patterns: dict[str, int]) -> Prior:
    """The prior of heuristic labellers and an annotator, who votes last: a kind of bad texts for each heuristic.

    A heuristic's rates on good texts are those on texts annotated as good; the annotator's shares of votes are those seen,
    wrong in ``WRONG`` of them. Both count for as many texts as there are, so they weigh the same at any size.
    """
    import numpy as np

    if not patterns:
        return plain_prior(0)
    k, total = max(map(len, patterns)), sum(patterns.values())
    good = {p: n for p, n in patterns.items() if p[-1] == "+"}
    n_good, judged = sum(good.values()), sum(n for p, n in patterns.items() if p[-1] != "0")
    kinds = max(k - 1, 1)
    counts = np.empty((k, 3, 1 + kinds))
    for j in range(k - 1):
        said = sum(n for p, n in good.items() if p[j] == "-")
        rate = (said + GOOD) / (n_good + 1)
        counts[j, :, 0] = np.array([rate, 1e-4, 1 - rate]) * total * (1 - BAD)
        for c in range(kinds):
            rate = OWN if c == j else OTHER
            counts[j, :, 1 + c] = np.array([rate, 1e-4, 1 - rate]) * FEW
    told = (judged + 0.5) / (total + 1)  # a text is judged or not, whatever it is
    counts[k - 1, :, 0] = np.array([told * WRONG, told * (1 - WRONG), 1 - told]) * total * (1 - BAD)
    counts[k - 1, :, 1:] = np.array([told * (1 - WRONG), told * WRONG, 1 - told])[:, None] * total * BAD / kinds
    return Prior(counts, np.array([1 - BAD, *[BAD / kinds] * kinds]))


class Estimate:
    """``share`` of bad texts; ``rates``: for each labeller the shares (of bad texts, of good texts) that get each vote. Unpacks to the two."""

    def __init__(self, shares, table):
        import numpy as np

        self.shares, self.table = shares, table
        self.share = float(1 - shares[0])
        bad = table[:, :, 1:] @ (shares[1:] / max(shares[1:].sum(), 1e-300))
        self.rates = [{v: (float(bad[j, i]), float(table[j, i, 0])) for i, v in enumerate(VOTES)} for j in range(len(table))]
        self._log = np.log(table)

    def __iter__(self):
        return iter((self.share, self.rates))

    def bad(self, pattern: str) -> float:
        """The probability that a text of these votes is bad."""
        return float(1 - _classes(self._log, self.shares, _coded([pattern]))[0, 0])


def _coded(patterns):
    import numpy as np

    return np.array([[VOTES.index(v) for v in p] for p in patterns], np.int64).reshape(len(patterns), -1)


def _classes(log, shares, codes):
    """The probability of each class for each pattern."""
    import numpy as np

    z = np.log(np.maximum(shares, 1e-300)) + sum(log[j][codes[:, j]] for j in range(codes.shape[1]))
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def estimate(patterns: dict[str, int], prior: Prior | None = None, rounds: int = 100, least: float = 0.0) -> Estimate:
    """Expectation-maximisation over counts of vote patterns, to rates of the largest posterior probability under the prior.

    Callers who know that a labeller is right in a share of its bad votes may say so by ``least`` (0: no such bound).
    Without a pattern no text is bad.
    """
    import numpy as np

    k, total = max(map(len, patterns), default=0), sum(patterns.values())
    prior = prior or plain_prior(k)
    table = prior.counts / prior.counts.sum(axis=1, keepdims=True) if k else np.empty((0, 3, 2))
    if not total:
        return Estimate(np.array([1.0, *[0.0] * (len(prior.shares) - 1)]), table)
    codes, n = _coded(patterns), np.array(list(patterns.values()), float)
    shares = prior.shares
    for _ in range(rounds):
        of = _classes(np.log(table), shares, codes) * n[:, None]
        shares = (of.sum(axis=0) + prior.shares) / (total + 1)
        counts = prior.counts.copy()
        for j in range(k):
            for v in range(3):
                counts[j, v] += of[codes[:, j] == v].sum(axis=0)
            if least:
                said = counts[j, 0].sum()
                good = min(counts[j, 0, 0], (1 - least) * said)
                counts[j, 0, 1:] *= (said - good) / max(counts[j, 0, 1:].sum(), 1e-300)
                counts[j, 0, 0] = good
        table = counts / counts.sum(axis=1, keepdims=True)
    return Estimate(shares, table)


def train(features: list, target: list[float], epochs: int = EPOCHS, alpha: float = 0.4, l1: float = 1.0, l2: float = 1.0):
    """Weights of a sparse logistic scorer (per-coordinate FTRL-proximal), the last one the constant."""
    import numpy as np

    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(features)):
            at = np.append(features[i], size - 1)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1 + np.sqrt(ni)) / alpha + l2))
            score = max(min(wi.sum(), 30), -30)
            g = 1 / (1 + np.exp(-score)) - target[i]
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - s * wi
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / alpha + l2))
    return w.astype(np.float32)


class Scorer:
    """Log-odds that a text is junk and that it is toxic."""

    def __init__(self, weights: dict, accuracies: dict | None = None):
        self.weights, self.accuracies = weights, accuracies

    def __call__(self, text: bytes) -> tuple[float, float]:
        at = buckets(text)
        return tuple(float(self.weights[a][at].sum() + self.weights[a][-1]) if text.split(None, 1) else -1.0 for a in AXES)


def _lexicons(rows: DataFrame, judged: dict[int, bool]) -> list[tuple]:
    """For each half of the texts (by the lowest bit of their key) the (words, word starts) that the other half's annotated toxic texts have.

    ``judged`` are the annotated texts' keys and whether they are toxic, a bounded sample.
    """

    import pyarrow as pa

    def telling(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            at, found = batch.column(0).to_pylist(), []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = lowered(dict.fromkeys((text or b"").split()))
                found.append(pa.array([b"w" + w for w in words] + [b"s" + w for w in starts_of(words)], pa.binary()))
            upto = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            toxic = batch.column(1)
            yield pa.RecordBatch.from_arrays([pa.array([a & 1 for a in at], pa.int32()), toxic, pa.ListArray.from_arrays(upto, pa.concat_arrays(found))], ["half", "toxic", "found"])

    if not any(judged.values()):
        return [(frozenset(), frozenset())] * 2
    wanted = F.broadcast(local_frame(rows.sparkSession, at=pa.array(judged.keys(), pa.int64()), toxic=pa.array(judged.values(), pa.bool_())))
    each = map_texts(rows.join(wanted, "at").select("at", "toxic", "text").dropDuplicates(["at"]), telling, "half int, toxic boolean, found array<binary>")
    counts = each.select("half", "toxic", F.explode("found").alias("x")).groupBy("half", "x").agg(F.count(F.when(F.col("toxic"), 1)).alias("bad"), F.count(F.lit(1)).alias("n"))
    counts = written(counts.where((F.col("bad") >= LEAST_TEXTS) & (F.col("bad") >= TELLING * F.col("n"))), "telling")
    halves = []
    for half in (0, 1):
        best = [bytes(r["x"]) for r in counts.where(F.col("half") == 1 - half).orderBy(F.col("bad").desc(), "x").limit(LEXICON).collect()]
        halves.append(tuple(frozenset(x[1:] for x in best if x[:1] == kind) for kind in (b"w", b"s")))
    return halves


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """The scorer for these documents.

    ``labels`` (id, quality 0/1, toxic 0/1) is one more labeller, which abstains on
    documents that it does not cover and where a value is null; conflicting rows for one id count as bad.
    Every document's votes count for the accuracies. The scorers are trained, and the lexicons learned, on
    at most ``sample`` documents, annotated ones first, then by hash, and on ``FEATURE_BYTES`` of features. With no document the scorer says -1 to all.

    Null texts are empty; long ones count whole. Rows that repeat id and text vote each and are trained on once. Other columns are not looked at, whatever their names.
    """
    key = keys(col(id_col), col(text_col))[0]
    rows = docs.select(col(id_col).alias("doc"), key.alias("at"), col(text_col).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    judged: dict[int, bool] = {}
    known = None
    if labels is not None:
        known = labels.select(col(id_col).alias("doc"), F.col("quality"), F.col("toxic").alias("is_toxic")).where("doc is not null").groupBy("doc").agg(F.min("quality").alias("quality"), F.max("is_toxic").alias("is_toxic"))
        known = written(known, "labels")
        about = rows.select("doc", "at").join(known.where("is_toxic is not null"), "doc").select("at", (F.col("is_toxic") == 1).alias("toxic"))
        judged = {r["at"]: r["toxic"] for r in by_hash(written(about, "annotated"), "at", sample)}
    lexicons = _lexicons(rows, judged)

    def voting(batches):
        import pyarrow as pa

        for batch in batches:
            found = [votes(t or b"", None, lexicons[at & 1]) for at, t in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([v[i] for v in found], pa.string()) for i in (0, 1)]], ["doc", "at", *AXES])

    voted = written(map_texts(rows, voting, f"doc {kind}, at long, junk string, toxic string"), "votes")
    said = {"junk": F.lit("0"), "toxic": F.lit("0")}
    if known is not None:
        voted = voted.join(known, "doc", "left")
        said["junk"] = F.when(F.col("quality") == 0, "-").when(F.col("quality") == 1, "+").otherwise("0")
        said["toxic"] = F.when(F.col("is_toxic") == 1, "-").when(F.col("is_toxic") == 0, "+").otherwise("0")
    voted = written(voted.select("at", *[F.concat(F.col(a), said[a]).alias(a) for a in AXES], ((said["junk"] == "0") & (said["toxic"] == "0")).alias("alone")), "patterns")
    models = {}
    for a in AXES:  # at most 3 ** labellers patterns
        patterns = {r[a]: r["count"] for r in voted.groupBy(a).count().collect()}
        models[a] = estimate(patterns, anchors(patterns))

    chosen = {r["at"]: r for r in by_hash(voted.where("not alone"), "at", sample)}
    chosen |= {r["at"]: r for r in by_hash(voted.where("alone"), "at", sample - len(chosen)) if r["at"] not in chosen}
    if not chosen:
        import numpy as np

        nothing = np.zeros((1 << BITS) + 1, np.float32)
        nothing[-1] = -1
        return Scorer({a: nothing for a in AXES}, models)

    def describing(batches):
        import pyarrow as pa

        for batch in batches:
            found = [buckets(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["at", "features"])

    import numpy as np
    import pyarrow as pa

    wanted = F.broadcast(local_frame(docs.sparkSession, at=pa.array(chosen, pa.int64())))
    described = map_texts(rows.join(wanted, "at").select("at", "text").dropDuplicates(["at"]), describing, "at long, features binary")

    features, held = {}, 0
    for r in written(described, "described").orderBy("at").toLocalIterator():
        held += len(r["features"])
        if held > FEATURE_BYTES and features:
            break
        features[r["at"]] = np.frombuffer(r["features"], np.int32)
    order = sorted(features)
    weights = {}
    for a in AXES:
        weights[a] = train([features[at] for at in order], [models[a].bad(chosen[at][a]) for at in order])
    return Scorer(weights, models)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, junk, toxic, keep) for each row: log-odds, and whether neither is above 0.

    Texts without words score -1 and are kept: nothing speaks against them; so are null ones. Repeated rows and null ids each get
    their row. Texts are judged whole. Other columns are not looked at. No rows, no result.
    """
    rows = docs.select(col(id_col).alias("doc"), col(text_col).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def scoring(batches):
        import pyarrow as pa

        for batch in batches:
            found = [scorer(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[i] for x in found], pa.float64()) for i in (0, 1)], pa.array([max(x) <= 0 for x in found], pa.bool_())], ["doc", "junk", "toxic", "keep"])

    return map_texts(rows, scoring, f"doc {kind}, junk double, toxic double, keep boolean").withColumnRenamed("doc", id_col)


def keep_good(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all their columns whatever their names."""
    place = docs.columns.index(text_col)

    def keeping(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [max(scorer(t or b"")) <= 0 for t in batch.column(place).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots can't pass otherwise
    return map_texts(plain, keeping, plain.schema).toDF(*docs.columns)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
