import random

from semlake.llm import chat, decontaminate, media, quality, token_counts, url_filter

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_token_histogram_is_exact(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    encode = token_counts.encoder().encode_ordinary
    lengths = sorted(len(encode(r.text)) for r in docs.collect())
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.count_tokens(docs)), block=64)
    for r in sums.collect():
        over = [n for n in lengths if n > r.n_tokens]
        assert (r.n_docs, r.docs_over, r.tokens_over) == (lengths.count(r.n_tokens), len(over), sum(over))
        assert (r.docs_total, r.tokens_total, r.truncated) == (len(lengths), sum(lengths), sum(min(n, r.n_tokens) for n in lengths))
    limits = [1, 17, 100, 513, 4096, 10**6]
    got = {r.context: (r.docs_over, r.truncated, r.lost) for r in token_counts.at_limits(sums, limits).collect()}
    assert got == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths), sum(max(n - x, 0) for n in lengths)) for x in limits}
    qs = {r.q: r.n_tokens for r in token_counts.quantiles(sums, [0.0, 0.5, 0.99, 1.0]).collect()}
    assert qs[1.0] == lengths[-1] and qs[0.5] == lengths[(len(lengths) + 1) // 2 - 1]


def test_media_round_trip_and_alignment():
    for data in (b"", b"x" * 576, b"y" * 577, bytes(range(256)) * 9):
        payload = media.payload_of(data)
        assert len(payload) % 576 == 0 and payload and payload.startswith(data) and media.from_pgm(media.to_pgm(payload)) == payload
    items = media.sequence('<p>one &amp; two<script>no</script></p><figure><img src="sha256:ab" alt="alt"><figcaption>cap <b>tion</b></figcaption></figure>three<img src="x.png" alt="other"><p>four')
    assert [(i["pos"], i["kind"], i["text"], i["caption"], i["digest"]) for i in items] == [(0, "text", "one & two", None, None), (1, "image", None, "cap tion", "ab"), (2, "text", "three", None, None), (3, "image", None, "other", None), (4, "text", "four", None, None)]


def test_media_query(spark):
    import hashlib
    import zlib

    from semlake.llm.queries import QUERIES

    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op2_media_columns"](spark, SMALL).collect():
        payload = media.payload_of(texts[r.doc_id])
        stored = media.to_pgm(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def test_url_rules_by_brute_force(spark):
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    extra = ["https://EXAMPLE.org/es/1", "http://x.example.org/en/12?q", "http://notexample.org/es/", "http://a.com/fr/", "http://a.com/de/x#y", "http://com/de/", "http://acom/de/", "ftp://u@h:1/p://q"]
    pages = spark.createDataFrame([*rows.items(), *enumerate(extra, 10**6)], "page_id long, url string")
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in url_filter.judge(pages).collect():
        host, path = plain_url(urls[r.page_id])
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict == ("block" if r.score > 0 else "allow")


def test_boosted_trees_learn():
    rng = random.Random(0)
    xs = [[rng.random(), rng.random(), rng.choice([0, 1])] for _ in range(2000)]
    ys = [float((x[0] > 0.6) != (x[2] == 1)) for x in xs]
    trees = url_filter.fit(xs[:1500], ys[:1500], names=("a", "b", "c"))

    def score(x, node):
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        return node

    right = sum((trees.start + sum(score(x, t) for t in trees.trees) > 0) == (y > 0.5) for x, y in zip(xs[1500:], ys[1500:]))
    assert right >= 485


def test_chat_recovers_roles(spark):
    turns = spark.read.parquet(f"{MEDIUM}/conversations.parquet")
    out = chat.recover(turns).withColumnRenamed("role", "got").join(turns, ["conv_id", "turn"])
    assert out.where("got = role").count() >= 0.95 * turns.count()


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    out = quality.score(docs, quality.fit(docs, seen)).drop("toxic").join(labels.where("doc_id % 2 = 1"), "doc_id")
    counts = {(r.quality, r.toxic, r.keep): r["count"] for r in out.groupBy("quality", "toxic", "keep").count().collect()}
    clean = counts.get((1, 0, True), 0), counts.get((1, 0, False), 0)
    junk = counts.get((0, 0, True), 0), counts.get((0, 0, False), 0)
    toxic = counts.get((1, 1, True), 0), counts.get((1, 1, False), 0)
    assert clean[0] >= 0.99 * sum(clean) and junk[1] >= 0.85 * sum(junk) and toxic[1] >= 0.55 * sum(toxic)


def test_weak_labels_find_the_accurate_labeller():
    rng = random.Random(5)
    patterns = {}
    for _ in range(4000):
        bad = rng.random() < 0.2
        p = "".join("0" if rng.random() < a else "-" if (rng.random() < r) == bad else "+" for a, r in ((0.1, 0.95), (0.3, 0.9), (0.5, 0.6)))
        patterns[p] = patterns.get(p, 0) + 1
    prior, rates = quality.estimate(patterns, least=0.0)  # these labellers err more than the heuristics may
    assert abs(prior - 0.2) < 0.05
    assert rates[0]["-"][0] > 0.7 and rates[0]["-"][1] < 0.1


def test_contamination_in_blocks(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    once = sorted(map(str, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 150)
    assert sorted(map(str, decontaminate.contamination(docs, items).collect())) == once
