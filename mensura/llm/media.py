"""Media columns (6): interleaved document sequences.

HTML is parsed to an ordered array of structs, text blocks and media references, where a
reference keeps its position, its caption and the SHA-256 digest of the payload. Payloads
are stored once per digest and task in a media table of lossless 8-bit grey pictures (PGM),
read back, checked against their digest and described by features; a join on the digest
resolves the references of all documents. Only descriptions meet in that join, never the
payloads, and equal ones are one row before it, so copies of one payload gather nowhere.

Null and empty texts have a payload of 64 zero bytes. Repeated rows are resolved each. An
empty table gives an empty result. Other columns are ignored. HTML that is null is empty;
broken HTML is parsed as far as it goes; a reference keeps its whole address, and store_inline()
puts the payload of a data: address into the media table; a reference without a stored payload stays, unresolved.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import doc_columns, each_piece, new_path, read, ship_package

BLOCK = 64
ITEM = "struct<position:int,kind:string,text:string,digest:string,source:string,caption:string>"
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul video audio".split())


class Interleaved(HTMLParser):
    """Collects items in document order; a figure's caption goes to its last medium, else the alt text is the caption."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.in_caption = False
        self.figure_from: int | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if not text:
            return
        if self.in_caption and self.figure_from is not None:
            media = [x for x in self.items[self.figure_from :] if x["kind"] == "media"]
            if media:
                media[-1]["caption"] = text
                return
        self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "source": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style", "template"):
            self.hidden += 1
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure_from = len(self.items)
        elif tag == "figcaption":
            self.in_caption = True
        elif tag in ("img", "source", "video", "audio") and not self.hidden:
            given = dict(attrs)
            source = given.get("src")
            if source:
                self.flush()
                self.items.append({"position": len(self.items), "kind": "media", "text": None, "digest": digest_of(source), "source": source, "caption": given.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCKS:
            self.flush()
        if tag == "figcaption":
            self.in_caption = False
        elif tag == "figure":
            self.figure_from = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def digest_of(source: str) -> str | None:
    """A reference's digest: named by it (media:<sha256>) or of its own data; None for other addresses."""
    if source.startswith("media:"):
        return source[6:].lower()
    if source.startswith("data:") and ";base64," in source:
        try:
            return hashlib.sha256(base64.b64decode(source.partition(";base64,")[2])).hexdigest()
        except ValueError:
            return None
    return None


def parse(html: str | None) -> list[dict]:
    parser = Interleaved()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, items): each page's interleaved sequence."""
    ship_package(pages.sparkSession)
    pages = pages.select(F.col(key).alias(key), F.col(html).alias("html"))
    item = pa.struct([("position", pa.int32()), *((x, pa.string()) for x in ("kind", "text", "digest", "source", "caption"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(x) for x in batch.column(1).to_pylist()], pa.list_(item))], names=[key, "items"])

    return pages.mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, items array<{ITEM}>")


def encode(payload: bytes) -> bytes:
    """A payload as a binary grey picture: 64 wide if its bytes are a multiple of that, else one line."""
    width = len(payload) if len(payload) % BLOCK else BLOCK
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def decode(media: bytes) -> bytes:
    magic, size, most, rest = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(rest) != width * height:
        raise ValueError("not a stored payload")
    return rest


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for _, data, off in each_piece(batches, 0):
        raw, digests, media = data.tobytes(), [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            payload = raw[a:b] + bytes(-(b - a) % BLOCK or (0 if b > a else BLOCK))
            digest = hashlib.sha256(payload)
            if digest.digest() not in seen:
                seen.add(digest.digest())
                digests.append(digest.hexdigest())
                media.append(encode(payload))
        if media:
            yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(media, pa.binary())], names=["digest", "media"])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads stored media back and describes them: sizes, digests, and the samples' mean, deviation, entropy and blank rows."""
    for rows, data, off in each_piece(batches, 1):
        raw, out = data.tobytes(), []
        for named, a, b in zip(rows.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            media = raw[a:b]
            payload = decode(media)
            digest = hashlib.sha256(payload).hexdigest()
            if digest != named:
                raise ValueError(f"the payload stored as {named} has digest {digest}")
            samples = np.frombuffer(payload, np.uint8)
            count = np.bincount(samples, minlength=256)
            p = count[count > 0] / max(len(samples), 1)
            mean = float(count @ np.arange(256)) / max(len(samples), 1)
            spread = (float(count @ (np.arange(256) - mean) ** 2) / max(len(samples), 1)) ** 0.5
            feature = f"mean={mean:.6f};deviation={spread:.6f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.6f};zeros={count[0]};levels={len(p)}"
            out.append((named, len(payload), digest, zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        if out:
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(payload_texts: DataFrame, path: str) -> None:
    """Writes the media table of a one-column frame of texts. A digest may occur once per task; its entries are equal."""
    payload_texts.mapInArrow(_store, "digest string, media binary").write.option("compression", "zstd").parquet(path)


def _inline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [base64.b64decode(x.partition(";base64,")[2]) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).hexdigest() for x in payloads], pa.string()), pa.array([encode(x) for x in payloads], pa.binary())], names=["digest", "media"])


def store_inline(items: DataFrame, path: str) -> None:
    """Adds the payloads that sequences() found in data: addresses to the media table, before it is resolved."""
    found = items.select(F.explode("items").alias("item")).where("item.digest is not null and startswith(item.source, 'data:')").select("item.source").distinct()
    found.mapInArrow(_inline, "digest string, media binary").write.mode("append").option("compression", "zstd").parquet(path)


def describe(spark: SparkSession, path: str) -> DataFrame:
    """One row per digest of a media table, from the stored bytes."""
    media = spark.read.schema("digest string, media binary").parquet(path)
    return media.mapInArrow(_described, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").distinct()


def resolve(items: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """One row per media reference: key, position, caption, and what the media table has for its digest, or nulls."""
    refs = items.select(key, F.explode("items").alias("item")).where("item.kind = 'media'").select(key, "item.position", "item.caption", "item.digest")
    return refs.join(media, "digest", "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page with one figure, whose payload is the document's text."""
    ship_package(spark)
    docs = doc_columns(read(spark, sf_dir, "documents"))
    path = new_path(spark, "media")
    store(docs.select("text"), path)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    pad = F.when(n == 0, F.lit(BLOCK)).otherwise(F.pmod(-n, F.lit(BLOCK)))
    digest = F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad))), 256)
    caption = F.concat_ws(" ", F.lit("document"), F.col("doc_id").cast("string"), F.lit("of"), n.cast("string"), F.lit("bytes"))
    pages = docs.select(F.to_json(F.struct("doc_id", n.cast("long").alias("n_bytes"))).alias("page_id"), F.concat(F.lit('<figure><img src="media:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>")).alias("html"))
    found = resolve(sequences(pages), describe(spark, path), "page_id")
    page = F.from_json("page_id", "doc_id long, n_bytes long")
    return found.select(page["doc_id"].alias("doc_id"), page["n_bytes"].alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
