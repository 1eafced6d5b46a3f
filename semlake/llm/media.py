"""Media columns: interleaved sequences of text and media references.

HTML becomes an ordered array of structs, one for each run of text or media
reference, captions included. Media payloads live in a store of their own
under the digest of their bytes, each in a lossless 8-bit greyscale image
format (binary PGM, width 24). A join by digest resolves references; the
positions and captions of the sequence stay what they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, map_texts, table, written

WIDTH = 24
#: Bytes that a payload is padded to a multiple of.
UNIT = 576
PAD = b"\xff"
ITEM = "struct<pos:int,kind:string,text:string,src:string,caption:string,alt:string,digest:string>"
# Elements that begin and end a line of their own, that hold no visible text, and that refer to media.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style template".split())
MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "source"}


def payload_of(data: bytes) -> bytes:
    """The bytes, padded by 255 up to a positive multiple of 576."""
    return data + PAD * (-len(data) % UNIT or (UNIT if not data else 0))


def to_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(media: bytes) -> bytes:
    """The samples of a binary PGM with one byte each."""
    magic, shape, most, samples = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not a whole 8-bit PGM")
    return samples


def features(payload: bytes) -> str:
    """Mean, deviation and the shares of four grey levels, in thousandths: equal payloads, equal features."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    levels = np.bincount(x >> 6, minlength=4) * 1000 // len(x)
    return ",".join(str(int(v)) for v in (x.mean() * 1000, x.std() * 1000, *levels))


def _plain(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _item(kind: str, **more) -> dict:
    return {"pos": 0, "kind": kind, "text": None, "src": None, "caption": None, "alt": None, "digest": None} | more


def _reader():
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        """Items of a page; ``figures`` are the open figures, each with its media and the parts of its caption."""

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.items, self.text, self.hidden, self.figures = [], [], [], []

        def caption(self) -> list[str] | None:
            return self.figures[-1]["caption"] if self.figures and self.figures[-1]["open"] else None

        def flush(self) -> None:
            if run := _plain(self.text):
                self.items.append(_item("text", text=run))
            self.text = []

        def handle_starttag(self, tag, attrs):
            if tag in HIDDEN:
                self.hidden.append(tag)
            if self.hidden:
                return
            given = dict(attrs)
            if tag in BLOCKS:
                self.gap()
            if tag == "figure":
                self.figures.append({"media": [], "caption": [], "open": False})
            elif tag == "figcaption" and self.figures:
                self.figures[-1]["open"] = True
                self.figures[-1]["caption"].append(" ")
            elif tag in MEDIA and given.get("src"):
                self.flush()
                src = given["src"]
                item = _item(MEDIA[tag], src=src, alt=given.get("alt"), caption=given.get("alt") or None, digest=src[7:] if src.startswith("sha256:") else None)
                for figure in self.figures[-1:]:
                    figure["media"].append(item)
                self.items.append(item)
            elif tag == "img" and given.get("alt"):
                self.handle_data(given["alt"])  # what is shown in place of an image that is nowhere

        def gap(self) -> None:
            """A line ends: in a caption it is a blank."""
            if (caption := self.caption()) is not None:
                caption.append(" ")
            else:
                self.flush()

        def handle_endtag(self, tag):
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
                return
            if self.hidden:
                return
            if tag == "figcaption" and self.figures:
                self.figures[-1]["open"] = False
            elif tag == "figure" and self.figures:
                self.gap()
                self.leave(self.figures.pop())
            elif tag in BLOCKS:
                self.gap()

        def leave(self, figure: dict) -> None:
            """The caption goes to the figure's media; without any it is text."""
            self.flush()
            if said := _plain(figure["caption"]):
                for item in figure["media"]:
                    item["caption"] = said
                if not figure["media"]:
                    self.items.append(_item("text", text=said))

        def handle_data(self, data):
            if not self.hidden:
                caption = self.caption()
                (self.text if caption is None else caption).append(data)

        def end(self) -> list[dict]:
            self.close()
            self.flush()
            while self.figures:  # never closed: a caption that is open holds the rest of the page, which is text
                figure = self.figures.pop(0)
                if figure["open"]:
                    figure["media"] = []
                self.leave(figure)
            for pos, item in enumerate(self.items):
                item["pos"] = pos
            return self.items

    return Reader()


def sequence(html: str | None) -> list[dict]:
    """Text runs and media references of a page, in order: (pos, kind, text, src, caption, alt, digest).

    All visible text is in a run or in a caption, blanks aside; scripts, styles, templates and
    comments are left out. A figure's caption goes to its media, wherever in the figure it stands; without media, or
    outside of a figure, it is text. Media without a figure's caption have their alternative text as caption. A source ``sha256:...`` is a digest. Null
    and empty pages give no items; elements that are never closed end with the page.
    """
    if not html:
        return []
    reader = _reader()
    reader.feed(html)
    return reader.end()


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc, items) and the columns ``also``: the ordered items of each page.

    Repeated pages each have theirs, null ids too. Null and empty pages have none. Other columns are not looked at.
    """
    rows = pages.select(col(id_col).alias("doc"), *[col(c) for c in also], col(html_col).alias("html"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "html")

    def run(batches):
        import pyarrow as pa

        item = pa.struct([("pos", pa.int32()), *((k, pa.string()) for k in ("kind", "text", "src", "caption", "alt", "digest"))])
        for batch in batches:
            found = pa.array([sequence(h) for h in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(item))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], "items"])

    return map_texts(rows, run, f"{shape}, items array<{ITEM}>")


def store(payloads: DataFrame, data_col: str = "data") -> DataFrame:
    """(digest, media), written in the shared folder: each payload under the SHA-256 of its padded bytes.

    Null and empty payloads are one unit of padding. Copies are stored once for each slice of a task that holds them; readers drop what
    is left of copies by digest. Payloads of any length are stored whole. Other columns are not looked at.
    """
    rows = payloads.select(col(data_col).alias("data"))

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        for batch in batches:
            held = {}
            for data in batch.column(0).cast(pa.binary()).to_pylist():
                payload = payload_of(data or b"")
                held.setdefault(sha256(payload).hexdigest(), payload)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([to_pgm(p) for p in held.values()], pa.binary())], ["digest", "media"])

    return written(map_texts(rows, run, "digest string, media binary"), "media", "zstd")


def inspect(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, one row for each digest: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Computed from what is read back; bytes that are no whole image fail the job.
    """

    def run(batches):
        from hashlib import sha256
        from zlib import crc32

        import pyarrow as pa

        for batch in batches:
            out = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload = from_pgm(stored)
                out.append((digest, len(payload), sha256(payload).hexdigest(), crc32(payload[-32:]), len(stored), sha256(stored).hexdigest(), features(payload)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    shape = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return written(map_texts(media, run, shape).dropDuplicates(["digest"]), "inspected")


def resolve(seqs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, other columns of ``seqs``, pos, kind, text, src, caption, alt, digest, and the columns of ``found``), one row for each item.

    Only references meet the store; text passes by. References without a stored payload keep
    nulls. A digest that very many items refer to is split by the skewed join; both sides are tables.
    """
    also = [c for c in seqs.columns if c not in ("doc", "items")]
    items = written(seqs.select("doc", *also, F.explode("items").alias("i")).select("doc", *also, "i.*"), "items", "zstd")
    held = items.where(F.col("digest").isNotNull()).join(found, "digest", "left")
    rest = items.where(F.col("digest").isNull())
    return held.unionByName(rest, allowMissingColumns=True).select("doc", *also, "pos", "kind", "text", "src", "caption", "alt", "digest", *[c for c in found.columns if c != "digest"])


def reference(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_bytes, html): each row's text as a page, its lines paragraphs, that refers twice to the text's bytes by
    digest: as a figure after the first line, whose caption tells their number, and at the end. Null texts are empty."""
    rows = docs.select(col(id_col).alias("doc"), col(text_col).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches):
        from hashlib import sha256
        from html import escape

        import pyarrow as pa

        for batch in batches:
            n, html = [], []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                first, *others = escape(text or "", quote=False).split("\n")
                at = sha256(payload_of(data)).hexdigest()
                n.append(len(data))
                html.append(f'<p>{first}</p><figure><img src="sha256:{at}"><figcaption>{len(data)} bytes</figcaption></figure><p>{"</p><p>".join(others)}</p><audio src="sha256:{at}"></audio>')
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(html, pa.string())], ["doc", "n_bytes", "html"])

    return map_texts(rows, run, f"doc {kind}, n_bytes long, html string")


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: how many items the document's page has, the figure's place among them and its caption, and the digest of all its text runs."""
    docs = table(spark, sf_dir, "documents")
    held = inspect(store(docs, "text"))
    seqs = sequences(reference(docs), "doc", "html", ("n_bytes",))
    runs = F.array_join(F.transform(F.filter("items", lambda i: i["kind"] == "text"), lambda i: i["text"]), " ")
    seqs = seqs.select("doc", "n_bytes", F.size("items").alias("n_items"), F.sha2(runs, 256).alias("text_sha256"), F.filter("items", lambda i: i["digest"].isNotNull()).alias("items"))
    items = resolve(seqs, held).where("kind = 'image'")
    return items.select(F.col("doc").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items", F.col("pos").alias("media_pos"), "caption", "text_sha256")
