"""Interleaved sequences of text and media from HTML, with payloads resolved by digest.

Parsing a page yields its texts and media references in document order, each with its
position, and captions stay with the reference they describe. References name payloads
as `digest:<sha256>`; a join on the digest resolves them against a store of payloads.
A reference without a payload stays in its place, unresolved. Null and empty pages have
no items. Equal payloads have equal digests and are described once.

The store keeps bytes losslessly as 8-bit RGB samples of PNG images WIDTH pixels wide:
a payload is the bytes padded with spaces to a positive multiple of a row.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.llm import textops as T
from growthlens.llm.tables import materialize, small_batches

WIDTH = 64
ROW = 3 * WIDTH
#: Fixed values of the PNG format.
PNG_MARK = b"\x89PNG\r\n\x1a\n"
PNG_RGB8 = bytes((8, 2, 0, 0, 0))
DEFLATE_LEVEL = 6
#: Elements whose text is no content, and those that end a run of text.
SILENT = frozenset(("script", "style", "noscript", "template", "head", "title"))
BLOCKS = frozenset(("address", "article", "aside", "blockquote", "br", "div", "dd", "dl", "dt", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"))
#: Fixed values of HTML: what a head may hold, and elements without an end tag.
HEAD = frozenset(("base", "link", "meta", "noscript", "script", "style", "template", "title"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Elements that no caption holds, so that they end one that was left open.
SECTIONS = frozenset(("article", "aside", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main", "nav", "section"))
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "iframe": "frame", "embed": "embed"}
ITEMS = "array<struct<position: int, kind: string, text: string, ref: string, digest: string>>"


class _Interleaved(HTMLParser):
    """Items in document order. End tags may lack: an element ends with what it stands in, a head with the first element that it cannot hold."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.silent = 0
        self.caption: list[str] | None = None
        #: Of each open figure: its last medium, and a caption that came before any.
        self.figures: list[list] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run.clear()
        if text:
            self._add("text", text, None)

    def _add(self, kind: str, text: str | None, ref: str | None) -> None:
        digest = ref[7:] if ref and ref.startswith("digest:") else None
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "ref": ref, "digest": digest})

    def _end(self, tag: str) -> None:
        """Ends the innermost open element of a name and all that was left open in it."""
        while self.count[tag]:
            last = self.open.pop()
            self.count[last] -= 1
            self.silent -= last in SILENT
            if last in BLOCKS:
                self._flush()
            if last == "figcaption":
                self._end_caption()
            if last == "figure":
                _, said = self.figures.pop()
                if said:  # a figure of a caption alone
                    self._add("text", said, None)
            if last == tag:
                return

    def _end_caption(self) -> None:
        said = " ".join("".join(self.caption or ()).split())
        self.caption = None
        if not said:
            return
        if not self.figures:
            self._add("text", said, None)
        elif self.figures[-1][0] is None:
            self.figures[-1][1] = said
        else:  # the caption belongs to the medium, not to the text after it
            self.items[self.figures[-1][0]]["text"] = said

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.count["head"] and tag not in HEAD and tag != "html":
            self._end("head")
        if tag in SECTIONS and self.count["figcaption"]:
            self._end("figure" if self.count["figure"] else "figcaption")
        if tag in BLOCKS or tag in MEDIA or tag == "figcaption":
            self._flush()
        if self.caption is not None:
            self.caption.append(" " if tag in BLOCKS else "")
        if tag not in VOID:
            self.open.append(tag)
            self.count[tag] += 1
            self.silent += tag in SILENT
        if tag == "figure":
            self.figures.append([None, None])
        if tag == "figcaption":
            self.caption = []
        if tag in MEDIA and not self.silent:
            known = dict(attrs)
            if known.get("src"):
                said = None
                if self.figures:
                    said, self.figures[-1][1] = self.figures[-1][1], None
                    self.figures[-1][0] = len(self.items)
                self._add(MEDIA[tag], said or known.get("alt") or known.get("title"), known["src"])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(tag)

    def handle_endtag(self, tag: str) -> None:
        self._end(tag)
        if tag in BLOCKS:  # one without a start parts texts too
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "head" and data.strip():
            self._end("head")
        if self.silent:
            return
        if self.caption is not None:
            self.caption.append(data)
        else:
            self.run.append(data)

    def read(self, page: str | None) -> list[dict]:
        self.feed(page or "")
        self.close()
        while self.open:
            self._end(self.open[-1])
        self._flush()
        return self.items


def png(payload: bytes) -> bytes:
    """A PNG whose samples are the payload, which is a positive multiple of ROW bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # the first byte of a line is its filter: none
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">II", WIDTH, len(rows)) + PNG_RGB8
    return PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), DEFLATE_LEVEL)) + chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of an image that png() made; fails on any other."""
    if image[:8] != PNG_MARK:
        raise ValueError("not a PNG image")
    at, data, head = 8, [], b""
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        head = body if kind == b"IHDR" else head
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height = struct.unpack(">II", head[:8])
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 3 * width + 1)
    if lines[:, 0].any() or head[8:] != PNG_RGB8:
        raise ValueError("a PNG image of another kind")
    return lines[:, 1:].tobytes()


def pad(data: bytes) -> bytes:
    return data + b" " * (ROW - len(data) % ROW if len(data) % ROW or not data else 0)


def describe(payload: bytes) -> str:
    """Size, mean and deviation of each channel, and a 64-bit difference hash of an 8 by 9 grid of means."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    mean, spread = pixels.mean((0, 1)), pixels.std((0, 1))
    grey = pixels.sum(2, dtype=np.int64)
    rows = np.arange(9) * len(grey) // 8
    grid = np.stack([np.add.reduceat(grey[a : max(b, a + 1)].sum(0), np.arange(9) * WIDTH // 9) for a, b in zip(np.minimum(rows[:-1], len(grey) - 1), rows[1:], strict=True)])
    bits = np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()
    return f"{WIDTH}x{len(pixels)} mean={','.join(f'{x:.4f}' for x in mean)} std={','.join(f'{x:.4f}' for x in spread)} dhash={bits}"


@T.tidy
def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page for each text, whose figure refers to the text's payload; a task stores a payload once."""
    stored: set[bytes] = set()
    for batch in batches:
        for a, b in T.slices(batch):
            part = batch.slice(a, b - a)
            pages, sizes, digests, images = [], [], [], []
            for text in part.column("text").to_pylist():
                raw = (text or "").encode()
                payload = pad(raw)
                digest = hashlib.sha256(payload)
                title = html.escape(" ".join((text or "").split(None, 9)[:8]))
                pages.append(f'<article><h1>{title}</h1><figure><img src="digest:{digest.hexdigest()}" alt="payload"><figcaption>{len(raw)} bytes as samples</figcaption></figure><p>{title}</p></article>')
                sizes.append(len(raw))
                new = digest.digest() not in stored
                stored.add(digest.digest())
                digests.append(digest.hexdigest() if new else None)
                images.append(png(payload) if new else None)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(pages), pa.array(digests, pa.string()), pa.array(images, pa.binary())], names=["id", "n_bytes", "html", "digest", "media"])


@T.tidy
def _parse(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = pa.array([_Interleaved().read(x) for x in batch.column("html").to_pylist()], kind)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "html"), items], names=[*(c for c in batch.schema.names if c != "html"), "items"])


@T.tidy
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, image in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
            payload = samples(image)
            found = hashlib.sha256(payload).hexdigest()
            if found != digest:
                raise ValueError(f"the store has {found} as {digest}")
            rows.append((digest, len(payload), found, zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), describe(payload)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns id, `keep` and items: the texts and media references of each page in order."""
    small_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("long").alias(id_col), *keep, F.col(html_col).alias("html"))
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("digest", pa.string())]))
    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "html")
    return source.mapInArrow(lambda it: _parse(it, kind), f"{plain}, items {ITEMS}")


def describe_store(store: DataFrame) -> DataFrame:
    """Reads the stored media of `store(digest, media)` back: one row a digest with sizes, digests and a feature."""
    small_batches(store.sparkSession)
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.mapInArrow(_describe, schema).dropDuplicates(["digest"])


def resolve(parsed: DataFrame, store: DataFrame, id_col: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each media reference: id, `keep`, position, caption, digest and what describe_store() says of it, null where the store has no such payload.

    What is said of payloads is narrow and written first: with plain tables on both
    sides, Spark can split the references to one very common payload.
    """
    media = parsed.select(id_col, *keep, F.explode("items").alias("i")).where("i.ref is not null").select(id_col, *keep, "i.position", F.col("i.text").alias("caption"), "i.digest")
    return media.join(materialize(describe_store(store)), "digest", "left")


def interleave(pages: DataFrame, store: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Columns id and items; each media item has the size and feature of its payload, at the position of its reference."""
    parsed = parse_pages(pages, id_col, html_col)
    # An item without a digest has nothing to look up; it gets a key of its own so that such items do not meet in one task.
    rows = parsed.select(id_col, F.explode_outer("items").alias("i")).withColumn("digest", F.coalesce("i.digest", F.concat(F.lit("-"), F.xxhash64(id_col, "i.position"))))
    found = rows.join(describe_store(store).select("digest", "payload_bytes", "feature"), "digest", "left")
    item = F.struct("i.position", "i.kind", "i.text", "i.ref", "i.digest", "payload_bytes", "feature")
    return found.groupBy(id_col).agg(F.sort_array(F.collect_list(F.when(F.col("i.position").isNotNull(), item))).alias("items"))


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a payload behind a page, and returns what the pages' references resolve to.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, position, caption; one row for each row of `docs`.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stored = materialize(source.mapInArrow(_render, "id long, n_bytes long, html string, digest string, media binary"))
    parsed = parse_pages(stored, "id", "html", keep=("n_bytes",))
    found = resolve(parsed, stored.where("media is not null").select("digest", "media"), "id", keep=("n_bytes",))
    return found.select(F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
