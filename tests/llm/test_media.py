"""Interleaved sequences: nothing visible is lost, and positions, captions and payloads stay aligned."""

import hashlib
from collections import Counter
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from semlake.llm import media

SF = "/root/testdata/sf0.001"


def said(items):
    return [(i["kind"], i["text"] or i["caption"]) for i in items]


def test_captions_wherever_they_stand():
    img = '<img src="sha256:ab" alt="alt">'
    assert said(media.sequence(f"a<figure><figcaption>cap</figcaption>{img}</figure>b")) == [("text", "a"), ("image", "cap"), ("text", "b")]
    assert said(media.sequence(f"a<figure>{img}<figcaption>c <b>d</b><p>e</figcaption></figure>b")) == [("text", "a"), ("image", "c d e"), ("text", "b")]
    assert said(media.sequence(f"a<figcaption>free</figcaption>{img}b")) == [("text", "a"), ("text", "free"), ("image", "alt"), ("text", "b")]
    assert said(media.sequence("<figure><figcaption>of nothing</figcaption></figure>z")) == [("text", "of nothing"), ("text", "z")]
    assert said(media.sequence(f"<figure>{img}<figcaption>never closed<p>rest of<p>the page")) == [("image", "alt"), ("text", "never closed rest of the page")]
    assert said(media.sequence(f"<figure>{img}{img.replace('ab', 'cd')}<figcaption>both</figcaption></figure>")) == [("image", "both")] * 2
    assert said(media.sequence(f"<figure>{img}<figure>{img}<figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>")) == [("image", "out"), ("image", "in")]


def test_lines_break():
    assert said(media.sequence("<td>a</td><td>b</td><h4>c</h4>d<blockquote>e</blockquote>f<pre>g</pre>h<b>i</b>j<br>k")) == [("text", x) for x in ("a", "b", "c", "d", "e", "f", "g", "hij", "k")]
    assert said(media.sequence('x<script>no</script>y<style>no</style><template>no<p>no</template>z<!-- no --><img alt="shown"> &lt;b&gt;')) == [("text", "xyzshown <b>")]
    assert media.sequence(None) == media.sequence("") == []


class Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag == "script"

    def handle_endtag(self, tag):
        self.hidden -= tag == "script" and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def visible(html):
    v = Visible()
    v.feed(html)
    v.close()
    return Counter("".join("".join(v.found).split()))


def held(items):
    """Characters of all text runs, and of each caption once that media of one figure share."""
    texts = "".join(i["text"] or "" for i in items)
    captions, last = "", None
    for i in items:
        if i["caption"] and not (last is not None and i["caption"] == last):
            captions += i["caption"]
        last = i["caption"]
    return Counter("".join((texts + captions).split()))


@given(st.lists(st.sampled_from(["<p>", "</p>", "<figure>", "</figure>", "<figcaption>", "</figcaption>", '<img src="sha256:aa">', '<audio src="u">', "<b>", "</b>", "<td>", "</table>", "<script>", "</script>", "&amp;", "a1", "b2 ", " c3", "<!-- x -->", "&", "<3"]), max_size=14))
@settings(max_examples=500, deadline=None)
def test_no_visible_character_is_lost(parts):
    # captions are told apart by a number of their own
    html = "".join(f"{p}{n}" if p[0].isalpha() else p for n, p in enumerate(parts))
    items = media.sequence(html)
    assert held(items) == visible(html)
    assert [i["pos"] for i in items] == list(range(len(items)))


def test_real_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    htmls = {r.page_id: r.html for r in pages.collect()}
    for r in media.sequences(pages).collect():
        assert held([i.asDict() for i in r["items"]]) == Counter("".join("".join(_without_style(htmls[r.doc])).split()))


def _without_style(html):
    import re

    v = Visible()
    v.feed(re.sub(r"<style>.*?</style>", "", html, flags=re.S))
    v.close()
    return v.found


def test_query_aligns_text_and_media(spark):
    from semlake.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_media_columns"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        lines = [" ".join(x.split()) for x in texts[r.doc_id].split("\n")]
        assert r.text_sha256 == hashlib.sha256(" ".join(x for x in lines if x).encode()).hexdigest()
        assert r.caption == f"{r.n_bytes} bytes" and r.media_pos == (1 if lines[0] else 0) and r.n_items == sum(map(bool, lines)) + 2
        payload = media.payload_of(texts[r.doc_id].encode())
        values = list(payload)
        mean = sum(values) / len(values)
        told = [int(mean * 1000), int((sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5 * 1000), *(sum(v >> 6 == k for v in values) * 1000 // len(values) for k in range(4))]
        assert all(abs(int(a) - b) <= 1 for a, b in zip(r.feature.split(","), told))


def test_resolved_items_keep_text_and_missing_references(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, data string")
    found = media.inspect(media.store(docs))
    at = hashlib.sha256(media.payload_of(b"x")).hexdigest()
    pages = spark.createDataFrame([(5, f'one<img src="sha256:{at}">two<img src="sha256:00" alt="gone"><img src="http://x/y.png">'), (6, None)], "page_id long, html string")
    rows = media.resolve(media.sequences(pages), found).orderBy("pos").collect()
    assert [(r.pos, r.kind, r.text or r.caption, r.payload_bytes) for r in rows] == [(0, "text", "one", None), (1, "image", None, 576), (2, "text", "two", None), (3, "image", "gone", None), (4, "image", None, None)]
