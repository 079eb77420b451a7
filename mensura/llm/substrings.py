"""Suffix-array dedup (1): bytes of passages of a least length that start more than once are removed.

Every window of ``least`` bytes has one anchor, its least hashed 48-byte gram (the leftmost
on ties), so equal windows have equal anchors at equal offsets. The windows of one anchor
make a segment; only segments whose anchor occurs more than once can hold repeats. Equal
segments are counted before any bytes move. The different segments of an anchor then meet,
each once, and interval expansion on their Burrows-Wheeler transform (bwt.py) finds the
windows that start in more than one of them; segments that can't share one are left out before. An anchor with very many different segments
is split: its windows, strings of exactly the least length, are counted by their hash.

Matches never cross documents; a document's own repeats count. Null and empty texts have
no bytes. Repeated rows are repeats of each other. An empty table gives an empty result.
Other columns are ignored. Hashes have 64 bits, and with the anchor 128.

Beside the removal, passages of a least number of words that stand in more than one document can be
reported (shared_passages): they are often shorter than ``least`` bytes. Their windows are of words
and have anchors, too; those of an anchor's different segments are counted by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.bwt import repeated_starts
from mensura.llm.common import BASE, BASE_INVERSE, RangeHash, doc_columns, each_piece, lean, materialize, mix, pieces, powers, read, ship_package, words

GRAM = 48
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words of the grams that are anchors of windows of words.
WORD_GRAM = 12
#: Occurrences of an anchor of words beyond which it is looked up in a broadcast list, of one in so many occurrences at most.
OFTEN = 10_000
#: Words of the shortest passage that the registered query reports.
PASSAGE_WORDS = 51
#: Different segments of an anchor beyond which its windows are counted by hash: so many, of 752 bytes at
#: most, are 3 MB, which a transform handles in about 200 MB of memory.
MANY = 4096
#: Bytes of segments that are transformed at once.
TRANSFORM_BYTES = 1 << 20
#: Bytes of text whose windows are anchored at once: some twenty arrays of 8 bytes a byte.
ANCHOR_BYTES = 1 << 18
#: Bytes of text whose segments are cut, or whose repeats are removed, at once; a longer text stands alone.
CUT_BYTES = 1 << 20


def anchors(h: RangeHash | WordHash, off: np.ndarray, least: int, size: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of a piece: row, first start (in the row), number of starts, anchor hash, segment hash.

    ``off`` are the rows' offsets in what ``h`` hashes, bytes or words, and ``size`` is a gram's.
    """
    grams = off[-1] - size + 1
    windows = np.maximum(np.diff(off) - least + 1, 0)
    if not windows.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    at = np.arange(grams)
    gram = h(at, at + size)
    low = (gram >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    width, span = 1, least - size + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    row = np.repeat(np.arange(len(off) - 1), windows)
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + off[row]
    anchor = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    count = np.diff(np.append(head, len(row)))
    begin, anchor, row = start[head], anchor[head], row[head]
    segment = mix(h(begin, begin + count - 1 + least) + (anchor - begin).astype(np.uint64))
    return row, begin - off[row], count, gram[anchor], segment


def _occurrences(least: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in each_piece(batches, 1, ANCHOR_BYTES):
            row, begin, count, anchor, segment = anchors(RangeHash(data), off, least)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)), rows.column(0).take(pa.array(row)), pa.array(begin, pa.int64()), pa.array(count, pa.int32())], names=["anchor", "segment", "rk", "start", "windows"])

    return run


@lean
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for rows, data, off in each_piece(batches, 2):
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([pack.compress(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary()), pa.array(np.diff(off))], names=["rk", "doc_id", "z", "size"])


def _by_bytes(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of about CUT_BYTES of text by the column of sizes."""
    off = np.concatenate([[0], np.cumsum(batch.column(size).to_numpy())])
    for i, j in pieces(off, CUT_BYTES):
        yield batch.slice(i, j - i)


def _cut(least: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in _by_bytes(batch, 2):
                lists, size = part.column(1), part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                fields = lists.flatten().flatten()
                starts, windows = fields[2].to_pylist(), fields[3].to_pylist()
                texts, owner = [unpack.decompress(x.as_py()) for x in part.column(0)], np.repeat(np.arange(len(part)), size).tolist()
                found = [texts[o][s : s + w - 1 + least] for o, s, w in zip(owner, starts, windows, strict=True)]
                yield pa.RecordBatch.from_arrays([*fields[:2], fields[4], pa.array(found, pa.binary())], names=["anchor", "segment", "many", "bytes"])

    return run


def _ranges(flags: np.ndarray) -> bytes:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.astype("<i4").tobytes()


def can_share(anchor: np.ndarray, strings: list[bytes], least: int) -> np.ndarray:
    """Which segments may share a window with another one of their anchor; the others surely don't.

    A shared window lies at one offset to the anchor in both. The offsets are taken in eight ranges;
    all windows of a range have some bytes in common, which the segments share then, too.
    """
    off = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
    data = np.frombuffer(b"".join(strings), np.uint8)
    h, at = RangeHash(data), np.arange(len(data) - GRAM + 1)
    own = np.repeat(np.arange(len(strings)), np.diff(off))
    hits = np.flatnonzero(h(at, at + GRAM) == anchor.view(np.uint64)[own[: len(at)]])
    row, first = np.unique(own[hits], return_index=True)
    place = np.full(len(strings), -1)
    place[row] = hits[first]
    maybe, room = place < 0, least - GRAM
    step = max(1, -(-(room + 1) // 8))
    for left in range(0, room + 1, step):
        begin, end = place - left, place + GRAM + max(0, room - left - step + 1)
        fits = np.flatnonzero((place >= 0) & (begin >= off[:-1]) & (end <= off[1:]))
        _, which, times = np.unique(mix(h(begin[fits], end[fits]) + anchor.view(np.uint64)[fits]), return_inverse=True, return_counts=True)
        maybe[fits[times[which] > 1]] = True
    return maybe


def _expand(least: int):
    """Segments sorted by anchor in the partition: blocks of whole anchors are transformed."""

    def solve(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        maybe = can_share(np.array([x[0] for x in rows], np.int64), [x[2] for x in rows], least)
        rows = [x for x, keep in zip(rows, maybe.tolist(), strict=True) if keep]
        found = repeated_starts([x[2] for x in rows], least) if rows else []
        out = [(a, s, _ranges(f)) for (a, s, _), f in zip(rows, found, strict=True) if f.any()]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["anchor", "segment", "ranges"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if size >= TRANSFORM_BYTES and held[-1][0] != a:
                    yield solve(held)
                    held, size = [], 0
                held.append((a, s, raw))
                size += len(raw)
        if held:
            yield solve(held)

    return run


def _windows(least: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in each_piece(batches, 2):
            count = np.diff(off) - least + 1
            row = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = off[row] + at
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(at, pa.int32()), pa.array(RangeHash(data)(begin, begin + least).view(np.int64))], names=["anchor", "segment", "at", "window"])

    return run


@lean
def _joined_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(2).to_pylist():
            flags = np.zeros(max(x) + 1, bool)
            flags[x] = True
            out.append(_ranges(flags))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["anchor", "segment", "ranges"])


class WordHash:
    """64-bit polynomial hashes of runs of words of one buffer; equal runs have equal hashes in any buffer."""

    def __init__(self, word: np.ndarray):
        self.down = powers(BASE_INVERSE, len(word))
        self.sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * powers(BASE, len(word))[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _word_hash(data: np.ndarray, off: np.ndarray) -> tuple[WordHash, np.ndarray]:
    start, end, first = words(data, off)
    return WordHash(RangeHash(data)(start, end)), first


def _word_occurrences(least: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 40
        for rows, data, off in each_piece(batches, 1, CUT_BYTES // 2):
            h, first = _word_hash(data, off)
            row, begin, count, anchor, segment = anchors(h, first, least, WORD_GRAM)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)), rows.column(0).take(pa.array(row)), pa.array(row + seen, pa.int64()), pa.array(begin, pa.int32()), pa.array(count, pa.int32())], names=["anchor", "segment", "rk", "place", "start", "windows"])
            seen += len(rows)

    return run


def _word_windows(least: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for part in (x for batch in batches for x in _by_bytes(batch, 2)):
            texts, size = [unpack.decompress(x.as_py()) for x in part.column(0)], part.column(1).value_lengths().to_numpy(zero_copy_only=False)
            h, word = _word_hash(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
            fields = part.column(1).flatten().flatten()
            count = fields[3].to_numpy().astype(np.int64)
            cut = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(cut)) - np.repeat(np.cumsum(count) - count, count)
            begin = (word[np.repeat(np.arange(len(part)), size)] + fields[2].to_numpy())[cut] + at
            take = pa.array(cut)
            yield pa.RecordBatch.from_arrays([*(fields[k].take(take) for k in (0, 1, 4, 5)), pa.array(at, pa.int32()), pa.array(h(begin, begin + least).view(np.int64))], names=["anchor", "segment", "low", "high", "at", "window"])

    return run


def _covered_words(least: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(i, 256) for batch in batches for i in range(0, len(batch), 256)):
            n_words, n_passages = [], []
            for found in part.column(1).to_pylist():
                edges = []
                for x in found:
                    r = [0, x["windows"]] if x["ranges"] is None else np.frombuffer(x["ranges"], "<i4").tolist()
                    edges += [(x["start"] + a, x["start"] + b - 1 + least) for a, b in zip(r[::2], r[1::2], strict=True)]
                end, total, runs = -1, 0, 0
                for a, b in sorted(edges):
                    runs += a > end
                    total += max(0, b - max(a, end))
                    end = max(end, b)
                n_words.append(total)
                n_passages.append(runs)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_passages, pa.int64())], names=["rk", "n_shared_words", "n_shared_passages"])

    return run


def materialize_lean(df: DataFrame, name: str) -> DataFrame:
    """As materialize, but the shuffle files of the job go at its end, not with some later garbage collection of the driver."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def shared_passages(docs: DataFrame, packed: DataFrame, least: int) -> DataFrame:
    """rk, n_shared_words, n_shared_passages of the rows that have ``least`` words in a row that another row has, too.

    Words are runs without ASCII white space. All words of such passages count, and a passage is a longest
    run of such words. Repeats within a row alone don't count. ``least`` is at least the gram's 12 words.
    """
    occurrences = materialize_lean(docs.select("rk", "text").mapInArrow(_word_occurrences(least), "anchor long, segment long, rk long, place long, start int, windows int"), "word-occurrences")
    again = occurrences.groupBy("anchor").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("times")).where("low < high")
    again = materialize_lean(again.select("anchor", "times"), "shared-word-anchors")
    # Most anchors are in one row alone; all that follows moves the others only. Those of frequent anchors stay where they are.
    often = F.broadcast(again.where(F.col("times") > OFTEN))
    rest = occurrences.join(often, "anchor", "left_anti").join(again.where(F.col("times") <= OFTEN), "anchor", "left_semi")
    occurrences = materialize_lean(occurrences.join(often, "anchor", "left_semi").union(rest), "shared-word-occurrences")
    segments = occurrences.groupBy("anchor", "segment").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.min("rk").alias("rk"), F.min_by("start", "rk").alias("start"), F.max("windows").alias("windows"))
    shared = materialize_lean(segments.join(segments.groupBy("anchor").agg(F.count("*").alias("kinds")), "anchor"), "shared-word-segments")
    wanted = shared.where("kinds > 1").groupBy("rk").agg(F.collect_list(F.struct("anchor", "segment", "start", "windows", "low", "high")).alias("cuts"))
    windows = materialize_lean(packed.join(wanted, "rk").select("z", "cuts", "size").mapInArrow(_word_windows(least), "anchor long, segment long, low long, high long, at int, window long"), "word-windows")
    again = windows.groupBy("anchor", "window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("anchor", "window")
    found = windows.where("low = high").join(again, ["anchor", "window"], "left_semi").groupBy("anchor", "segment").agg(F.collect_set("at").alias("at")).mapInArrow(_joined_ranges, "anchor long, segment long, ranges binary")
    repeats = shared.where("low < high").select("anchor", "segment", F.lit(None).cast("binary").alias("ranges")).union(found)
    of_row = occurrences.join(repeats, ["anchor", "segment"]).groupBy("rk").agg(F.collect_set(F.struct("start", "windows", "ranges")).alias("found"))
    return materialize_lean(of_row.mapInArrow(_covered_words(least), "rk long, n_shared_words long, n_shared_passages long"), "shared-words")


def _removed(least: int, with_text: bool, beside: list[str]):
    schema = pa.schema([*((x, pa.int64()) for x in ("doc_id", "n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), *[("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))][: 2 * with_text]])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for part in (x for batch in batches for x in _by_bytes(batch, 3)):
            out = []
            for doc, z, found in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                raw = unpack.decompress(z.as_py())
                if not found.is_valid:
                    out.append((doc, len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), *((raw, []) if with_text else ())))
                    continue
                items = found.values
                starts, windows, ranges = (items.field(k) for k in range(3))
                change = np.zeros(len(raw) + 1, np.int64)
                for s, n, r in zip(starts.to_pylist(), windows.to_pylist(), ranges.to_pylist(), strict=True):
                    edges = np.array([0, n]) if r is None else np.frombuffer(r, "<i4")
                    np.add.at(change, s + edges[::2], 1)
                    np.add.at(change, s + edges[1::2] - 1 + least, -1)
                gone = np.cumsum(change[:-1]) > 0
                spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((doc, len(raw), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), *((kept, [{"start": int(a), "end": int(b)} for a, b in spans]) if with_text else ())))
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in out], t) for k, t in enumerate(schema.types)), *part.columns[4:]], names=[*schema.names, *beside])

    return run


def remove_repeats(docs: DataFrame, least: int = 400, with_text: bool = True, passage_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the kept bytes and the removed spans.

    With ``passage_words`` n_shared_words and n_shared_passages follow, of the passages of so many words or more that
    another row has, too (shared_passages); they are told of, not removed. ``least`` is at least the gram's 48 bytes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = doc_columns(docs).withColumn("rk", F.xxhash64("doc_id", "text"))
    occurrences = materialize_lean(docs.select("rk", "text").mapInArrow(_occurrences(least), "anchor long, segment long, rk long, start long, windows int"), "occurrences")
    segments = occurrences.groupBy("anchor", "segment").agg(F.count("*").alias("times"), F.min("rk").alias("rk"), F.min_by("start", "rk").alias("start"), F.max("windows").alias("windows"))
    shared = segments.groupBy("anchor").agg(F.sum("times").alias("all_times"), F.count("*").alias("kinds")).where("all_times > 1").select("anchor", "kinds")
    shared = materialize_lean(segments.join(shared, "anchor"), "shared-segments")

    packed = docs.select("rk", "doc_id", "text").mapInArrow(_packed, "rk long, doc_id long, z binary, size long")
    wanted = shared.where("kinds > 1").groupBy("rk").agg(F.collect_list(F.struct("anchor", "segment", "start", "windows", (F.col("kinds") > MANY).alias("many"))).alias("cuts"))
    texts = packed.join(wanted, "rk").select("z", "cuts", "size").mapInArrow(_cut(least), "anchor long, segment long, many boolean, bytes binary")
    has_many = not shared.where(F.col("kinds") > MANY).isEmpty()
    if has_many:
        texts = materialize_lean(texts, "segments")
    few = texts.where("not many").select("anchor", "segment", "bytes")
    found = few.repartition("anchor").sortWithinPartitions("anchor", "segment").mapInArrow(_expand(least), "anchor long, segment long, ranges binary")
    if has_many:
        windows = materialize_lean(texts.where("many").select("anchor", "segment", "bytes").mapInArrow(_windows(least), "anchor long, segment long, at int, window long"), "windows")
        again = windows.groupBy("anchor", "window").agg(F.count_distinct("segment").alias("n")).where("n > 1").select("anchor", "window")
        by_segment = windows.join(again, ["anchor", "window"], "left_semi").groupBy("anchor", "segment").agg(F.collect_set("at").alias("at"))
        found = found.union(by_segment.mapInArrow(_joined_ranges, "anchor long, segment long, ranges binary"))
    twice = shared.where("times > 1").select("anchor", "segment", F.lit(None).cast("binary").alias("ranges"))
    once = shared.where("times = 1").select("anchor", "segment").join(found, ["anchor", "segment"])
    repeats = twice.union(once)
    of_row = occurrences.join(repeats, ["anchor", "segment"]).groupBy("rk").agg(F.collect_set(F.struct("start", "windows", "ranges")).alias("found"))
    out = packed.join(of_row, "rk", "left")
    beside = ["n_shared_words", "n_shared_passages"] if passage_words else []
    if passage_words:
        out = out.join(shared_passages(docs, packed, passage_words), "rk", "left").fillna(0, beside)
    types = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<start:long,end:long>>" if with_text else "")
    return out.select("doc_id", "z", "found", "size", *beside).mapInArrow(_removed(least, with_text, beside), ", ".join([types, *(f"{x} long" for x in beside)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False)


def query_with_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the columns of query(), then those of passages of over 50 words in more than one document."""
    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False, passage_words=PASSAGE_WORDS)
