"""The pipeline's near-copy stage against brute-force Jaccard."""

import random
from collections import Counter

import corpus_pipeline
from semlake.llm import near_copies

WORDS = [f"w{i}" for i in range(400)]


def plain_kept(texts, size=5):
    """Smallest index of each component of texts whose shingle sets have a Jaccard similarity of 0.8 at least."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 5 * both >= 4 * (len(a) + len(sets[j]) - both) > 0:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in root}


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", "  ", "one", "One", "two words", "a b c d e", "a b c d e f"]
    common = " ".join(rng.choice(WORDS) for _ in range(9))
    for _ in range(25):  # copies on both sides of 0.8, some through others
        base = " ".join(rng.choice(WORDS) for _ in range(rng.choice([12, 40, 120, 300])))
        texts.append(base)
        for _ in range(rng.randrange(4)):
            texts.append(edited(rng, rng.choice([base, texts[-1]]), rng.randrange(1, 1 + len(base.split()) // 30 + 1)))
        texts.append(common + " " + " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 30]))))
    base = " ".join(rng.choice(WORDS) for _ in range(200))  # a large group
    texts += [edited(rng, base, rng.randrange(1, 4)) for _ in range(60)]
    rng.shuffle(texts)
    return texts


def test_stage_same_as_brute_force(spark, monkeypatch):
    texts = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = plain_kept(texts)
    assert len(want) < len(texts) - 60
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want
    monkeypatch.setattr(near_copies, "PAIRS", 2)  # all by rounds
    for rounds in (0, 1):
        monkeypatch.setattr(near_copies, "ROUNDS", rounds)
        assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want


def test_prefixes_leave_room_for_no_miss():
    for n in range(1, 200):
        assert near_copies.prefix(n) == n - -(-4 * n // 5) + 1


def test_one_row_of_each_component(spark):
    text, other = " ".join(WORDS[:50]), " ".join(WORDS[100:150])
    near = text.replace("w49", "x")
    rows = [(1, text, "p"), (1, text, "q"), (1, text, "q"), (2, near, "r"), (2, other, "s"), (None, text, "t"), (None, "of no id", "u"), (None, "of no id", "v")]
    out = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    kept = corpus_pipeline.drop_near_copies(spark, out, "").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == {(1, text): 1, (2, other): 1, (None, "of no id"): 1} and kept[0].asDict().keys() == {"doc_id", "text", "k1"}


def test_no_rows(spark):
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_simhash_finds_pairs_first(spark, monkeypatch):
    """The stage's links come from fingerprints of five-word shingles where these are near, and only the others from shared shingles."""
    rng = random.Random(5)
    base = [" ".join(rng.choice(WORDS) for _ in range(300)) for _ in range(6)]
    texts = base + [edited(rng, t, 1) for t in base]
    seen = []
    compared = near_copies.simhash.candidates

    def spied(found, radius):
        seen.append(({r.fp for r in found.collect()}, compared(found, radius).collect()))
        return compared(found, radius)

    monkeypatch.setattr(near_copies.simhash, "candidates", spied)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == plain_kept(texts) == set(range(6))
    (found, pairs), = seen
    want = {near_copies.simhash.of_hashes(near_copies.shingles(t.encode(), 5)) for t in texts}
    apart = {(a, b) for a in want for b in want if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= near_copies.RADIUS}
    assert found == want and apart and {(r.a, r.b) for r in pairs} == apart


def test_masks_of_radius_six_miss_no_pair_and_have_many_bits():
    masks, rng = near_copies.simhash.masks(6), random.Random(1)
    assert len(masks) == 127 and min((m & (2**64 - 1)).bit_count() for m in masks) >= 32
    for _ in range(3000):
        d = sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 7)))
        assert any(d & m == 0 for m in masks)


def joined_rows(spark, since):
    """Rows that each join of shingles with themselves made, of the executions after the first ``since``."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executions, out = store.executionsList(), []
    for k in range(since, executions.size()):
        at = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            if "Join" in node.name() and "sig#" in node.desc() and "<" in node.desc():
                for j in range(node.metrics().size()):
                    m = node.metrics().apply(j)
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        out.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return out


def test_texts_of_common_passages_are_not_joined_pair_by_pair(spark, monkeypatch):
    """Texts share two thirds of their words with 29 others and are copies of none; the sample for the order sees few of them."""
    rng = random.Random(7)
    passages = [" ".join(rng.choice(WORDS) for _ in range(120)) for _ in range(20)]
    texts = [p + " " + " ".join(rng.choice(WORDS) for _ in range(60)) for p in passages for _ in range(30)]
    texts += [edited(rng, t, 1) for t in texts[::50]]
    monkeypatch.setattr(near_copies, "SAMPLE", 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    store = spark._jsparkSession.sharedState().statusStore()
    since = store.executionsList().size()
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(range(600))
    assert sum(joined_rows(spark, since)) < 10 * len(texts)
