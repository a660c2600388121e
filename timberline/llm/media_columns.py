"""Operator 9: media columns of interleaved documents.

`sequences` parses HTML to the ordered parts of a page: text parts and media
references, each with its position, and for media the caption and the digest
that its address names.  `store` puts payloads into a table of media keyed by
digest, as binary 8-bit grey maps (PGM) that hold every byte as a sample.
`features` reads stored media back and measures them.  `resolve` joins parts
to media on the digest, so positions and captions stay with their payloads.

Defined results: null or empty HTML has no parts; a reference whose digest is
in no table keeps its part with null features; equal payloads are one medium;
null and empty texts have a payload of 64 zero bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import written

#: Samples in a row of a stored medium; payloads are padded to a multiple of it.
WIDTH = 64
#: Digests that a task remembers.
REMEMBERED = 200_000
PARTS = "array<struct<position: int, kind: string, text: string, digest: string, caption: string>>"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Parts(HTMLParser):
    """Text and media of a page in their order; scripts and styles are left out."""

    MEDIA = ("img", "audio", "video", "source", "embed")
    BREAKS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "figure", "pre", "blockquote")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.buffer: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figure: int | None = None

    def flush(self) -> None:
        text = "".join(self.buffer).strip()
        self.buffer = []
        if text:
            self.parts.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                found = re.match(r"sha256:([0-9a-f]{64})$", a["src"])
                self.parts.append(["media", a["src"], found[1] if found else None, a.get("alt") or a.get("title")])
        elif tag == "figcaption":
            self.caption = []
        elif tag in self.BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = len(self.parts)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = "".join(self.caption).strip(), None
            for part in self.parts[self.figure if self.figure is not None else len(self.parts) :]:
                if part[0] == "media":
                    part[3] = text
        elif tag in self.BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.buffer if self.caption is None else self.caption).append(data)


def parts_of(html: str | None) -> list[dict]:
    parser = _Parts()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": k, "kind": kind, "text": text, "digest": digest, "caption": caption} for k, (kind, text, digest, caption) in enumerate(parser.parts)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, parts) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([parts_of(x) for x in some.column(1).to_pylist()], kind)], ["id", "parts"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, parts {PARTS}").withColumnRenamed("id", id_col)


def padded(text: Column) -> Column:
    """UTF-8 bytes of a text, with zero bytes up to a positive multiple of WIDTH."""
    raw = F.coalesce(text.cast("string").cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    lack = F.when(n == 0, WIDTH).otherwise((WIDTH - n % WIDTH) % WIDTH)
    return F.concat(raw, F.expr(f"unhex(repeat('00', {WIDTH}))").substr(F.lit(1), lack.cast("int")))


def pack(payload: bytes) -> bytes:
    """The payload as a binary grey map of WIDTH samples a row; its length is a positive multiple of WIDTH."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def unpack(stored: bytes) -> bytes:
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", stored[:64])
    n = int(head[1]) * int(head[2])
    if len(stored) != head.end() + n:
        raise ValueError("a stored medium was cut")
    return stored[head.end() :]


def measure(stored: bytes) -> tuple[int, str, int, int, str, str]:
    payload = unpack(stored)
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    deviation = float(np.sqrt(max(0.0, counts @ np.arange(256) ** 2 / len(samples) - mean * mean)))
    feature = f"{WIDTH}x{len(samples) // WIDTH};mean={mean:.4f};deviation={deviation:.4f};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.4f}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def store(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Writes a table (digest, media) and returns it as read back; null payloads are left out, of equal ones a task stores the first, as far as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            new = [not (d in seen or seen.add(d)) for d in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            for k in range(0, batch.num_rows, 200):
                some = batch.slice(k, 200)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([pack(x) for x in some.column(1).to_pylist()], pa.binary())], ["digest", "media"])

    rows = payloads.select(F.sha2(F.col(payload_col), 256).alias("digest"), F.col(payload_col).alias("payload")).filter("payload is not null")
    return written(rows.mapInArrow(run, "digest string, media binary"))


def features(media: DataFrame) -> DataFrame:
    """One row per digest with what its stored form holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", *(x.split()[0] for x in FEATURES.split(", "))]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            found = [measure(x) for x in batch.column(1).to_pylist()] if batch.num_rows else []
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    return media.select("digest", "media").mapInArrow(run, f"digest string, {FEATURES}").dropDuplicates(["digest"])


def apart_text(df: DataFrame, key: str) -> DataFrame:
    """As components.apart(), for a text key."""
    return df.withColumn(key, F.concat(key, F.lit("")))


def resolve(pages: DataFrame, found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A row for each media part of `sequences`: id, position, caption, digest, and the features of its payload."""
    parts = pages.select(id_col, F.explode("parts").alias("_part")).filter("_part.kind = 'media'")
    parts = parts.select(id_col, F.col("_part.position").alias("position"), F.col("_part.caption").alias("caption"), F.col("_part.digest").alias("digest"))
    return parts.join(apart_text(found, "digest"), "digest", "left")


def page_of(text: Column, payload: Column, caption: Column) -> Column:
    """A page that holds a text and, after it, a reference to its payload."""
    escaped = F.coalesce(F.replace(F.replace(text.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(""))
    return F.concat(F.lit("<article><p>"), escaped, F.lit('</p><figure><img src="sha256:'), F.sha2(payload, 256), F.lit('"><figcaption>'), F.coalesce(caption, F.lit("")), F.lit("</figcaption></figure></article>"))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Features of every text as a stored medium: pages that refer to the texts' payloads are parsed and resolved by digest."""
    text = F.col(text_col)
    media = store(docs.select(padded(text).alias("payload")))
    pages = docs.select(
        F.struct(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long").alias("n_bytes")).alias("page_id"),
        page_of(text, padded(text), F.col(id_col).cast("string")).alias("html"),
    )
    rows = resolve(sequences(pages), features(media))
    names = [x.split()[0] for x in FEATURES.split(", ")]
    return rows.select(F.col("page_id.id").alias(id_col), F.col("page_id.n_bytes").alias("n_bytes"), *names, "position", "caption")
