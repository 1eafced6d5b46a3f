import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from semlake.llm import _graph, simhash
from semlake.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=2):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_same_as_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    want = plain_components(fps)
    got = QUERIES["op9_simhash"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
@settings(max_examples=300, deadline=None)
def test_covering(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    assert any((x & m & (2**64 - 1)) == (y & m & (2**64 - 1)) for m in simhash.masks(2))


def test_masks_of_radius_four_cover():
    rng = random.Random(1)
    for _ in range(300):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(d & m == 0 for m in simhash.masks(4))


def test_large_buckets_link_the_same(spark, monkeypatch):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(150):
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.choice([1, 2, 3])):
            x ^= 1 << b
        fps.add(x)
    signed = [(simhash._signed(x),) for x in sorted(fps)]
    found = spark.createDataFrame(signed, "fp long")
    want = plain_components({x: x & (2**64 - 1) for (x,) in signed})
    groups = {}
    for x, r in want.items():
        groups.setdefault(r, set()).add(x)
    for pairs in (2, 10_000):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        roots = {r.v: r.root for r in _graph.components(simhash.links(found, 2)).collect()}
        got = {}
        for (x,) in signed:
            got.setdefault(roots.get(x, x), set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, x) for x in range(1001, 1030)] + [(5000, 5000), (7, 3), (2001, 2000)]
    out = {r.v: r.root for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in range(1000, 1030)} == {1000} and out[2001] == 2000 and 5000 not in out
