"""LM scoring (10): prediction by partial matching over bytes, and a word-unigram base.

The byte-context trie is counted over every training document, and every context that occurs
``least`` times is used. Escapes are estimated by the number of distinct successors (method
C); a symbol that a longer context has seen is excluded from the shorter ones.

The documents are dealt to chunks of bounded bytes by a hash. A chunk sends its distinct
n-grams with their training counts to buckets by their last context bytes, where all chunks'
counts meet and every n-gram gets its probability, and gets these back: the trie grows with
the corpus, and no place holds it whole. Only contexts of up to two bytes, whose number bytes
bound, are worked out on the driver. The base does the same with words and buckets of word
hashes; a frequent word or n-gram is one entry per chunk.

A caller may ask for a small model of its own with ``most_contexts``: the contexts that occur
most, compiled to an automaton whose state is the longest kept context. The query doesn't.

Null and empty texts consist of the end symbol alone. Repeated rows count each. An empty
table gives an empty result; without training rows every byte is equally likely. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import LOWER, RangeHash, each_piece, materialize, mix, partitions_for, pieces, read, ship_package, text_buffer, words
from mensura.llm.linear import crc_of_id

#: The end symbol; also what stands before a text. A byte 0 in a text is counted as 255, which UTF-8 never has.
END = 0


def stream(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' lower-cased bytes, ``order`` ends before the first and after each; the positions of each row's first symbol."""
    rows = len(off) - 1
    at = off + order * (np.arange(rows + 1) + 1)
    out = np.zeros(len(data) + order * (rows + 1), np.uint8)
    out[np.arange(len(data)) + order * np.repeat(np.arange(rows) + 1, np.diff(off))] = np.where(data == 0, 255, LOWER[data])
    return out, at


def grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """At each position from ``order`` on, that symbol in the lowest byte and the ones before in the bytes above."""
    n = len(symbols) - order
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(order, -1, -1):
        out = (out << np.uint64(8)) | symbols[order - k : order - k + n]
    return out


def row_grams(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all symbols, each row's end included, and their rows."""
    symbols, at = stream(data, off, order)
    # Of the ends that follow a row only the first is a symbol; the others are context.
    wanted = np.ones(len(symbols) - order, bool)
    for k in range(1, order):
        wanted[at[1:] - order - order + k] = False
    return grams(symbols, order)[wanted], np.repeat(np.arange(len(off) - 1), np.diff(off) + 1)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, counts, len(unique)).astype(np.int64)


def _counted(order: int, buckets: int):
    def flush(parts: list) -> pa.RecordBatch:
        keys, counts = _merge(parts)
        bucket = ((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64) % buckets
        by = np.argsort(bucket, kind="stable")
        keys, counts, edges = keys[by].astype("<u8"), counts[by].astype("<i8"), np.searchsorted(bucket[by], np.arange(buckets + 1))
        some = [b for b in range(buckets) if edges[b] < edges[b + 1]]
        blob = lambda a: pa.array([a[edges[b] : edges[b + 1]].tobytes() for b in some], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), blob(keys), blob(counts)], names=["bucket", "grams", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, data, off in each_piece(batches, 0):
            symbols, at = stream(data, off, order)
            found = grams(symbols, order)
            # Of the ends that follow a row only the first is a symbol; the others are context.
            wanted = np.ones(len(found), bool)
            for k in range(1, order):
                after = at[1:] - order - order + k
                wanted[after] = False
            parts.append(np.unique(found[wanted], return_counts=True))
            held += len(parts[-1][0])
            if held > 3_000_000:
                parts = [_merge(parts)]
                if len(parts[0][0]) > 1_500_000:
                    yield flush(parts)
                    parts = []
                held = sum(len(k) for k, _ in parts)
        if parts:
            yield flush(parts)

    return run


def _contexts(order: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _merge([(np.frombuffer(k, "<u8"), np.frombuffer(c, "<i8")) for k, c in zip(table.column("grams").to_pylist(), table.column("counts").to_pylist(), strict=True)])
        out = []
        for k in range(order + 1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            unique, inverse = np.unique(keys & mask, return_inverse=True)
            total = np.bincount(inverse, counts, len(unique)).astype("<i8")
            context, symbol = unique >> np.uint64(8), (unique & np.uint64(255)).astype(np.uint8)
            edges = np.concatenate([np.flatnonzero(np.diff(context, prepend=context[:1] + np.uint64(1))), [len(unique)]])
            sums = np.add.reduceat(total, edges[:-1]) if len(edges) > 1 else np.zeros(0, np.int64)
            for a, b, n in zip(edges[:-1].tolist(), edges[1:].tolist(), sums.tolist(), strict=True):
                if k < 2 or n >= least:
                    out.append((k, int(context[a]), n, symbol[a:b].tobytes(), total[a:b].tobytes()))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["depth", "context", "total", "symbols", "counts"])

    return run


@dataclass
class Automaton:
    """State: the longest kept context. ``code`` gives each byte's column; ``log10`` and ``following`` are by state and column."""

    order: int
    code: np.ndarray
    log10: np.ndarray
    following: np.ndarray

    def score(self, data: np.ndarray, off: np.ndarray, segment: int = 2048) -> np.ndarray:
        """log10 of each row's probability, its end included."""
        rows = len(off) - 1
        symbols, at = stream(data, off, self.order)
        columns = self.code[symbols[self.order :]]
        n, warm, width = len(columns), self.order, self.log10.shape[1]
        parts = -(-n // segment)
        padded = np.zeros(warm + parts * segment, columns.dtype)
        padded[:warm] = self.code[END]
        padded[warm : warm + n] = columns
        view = np.lib.stride_tricks.sliding_window_view(padded, warm + segment)[::segment]
        steps = np.ascontiguousarray(view.T)
        out = np.empty((segment, parts), np.float32)
        state, flat, follow = np.zeros(parts, np.int64), self.log10.ravel(), self.following.ravel()
        for t in range(warm + segment):
            cell = state * width + steps[t]
            if t >= warm:
                out[t - warm] = flat[cell]
            state = follow[cell].astype(np.int64)
        sums = np.concatenate([[0.0], np.cumsum(out.T.ravel()[:n], dtype=np.float64)])
        begin = at[:-1] - self.order
        return sums[begin + np.diff(off) + 1] - sums[begin] if rows else np.zeros(0)


def compile_trie(nodes: list[tuple[int, int, int, bytes, bytes]], order: int) -> Automaton:
    """Probabilities and transitions of the kept contexts; nodes: (depth, context, total, symbols, counts)."""
    merged: dict[tuple[int, int], np.ndarray] = {}
    for depth, context, _, symbols, counts in nodes:
        row = merged.setdefault((depth, context), np.zeros(256))
        row[np.frombuffer(symbols, np.uint8)] += np.frombuffer(counts, "<i8")
    merged.setdefault((0, 0), np.zeros(256))
    kept: dict[tuple[int, int], int] = {}
    ordered = sorted(merged)
    for depth, context in ordered:  # a context stays with its suffix and its prefix
        if depth < 2 or ((depth - 1, context & ((1 << 8 * (depth - 1)) - 1)) in kept and (depth - 1, context >> 8) in kept):
            kept[depth, context] = len(kept)
    seen = np.zeros(256, bool)
    seen[END] = True
    for key in kept:
        seen |= merged[key] > 0
    alphabet = np.flatnonzero(seen)
    code = np.full(256, len(alphabet), np.uint8 if len(alphabet) < 255 else np.int16)
    code[alphabet] = np.arange(len(alphabet))
    width, others = len(alphabet) + 1, max(1, 256 - len(alphabet))
    probability = np.zeros((len(kept), width))
    following = np.zeros((len(kept), width), np.int32)
    uniform = np.full(width, 1 / 256)
    uniform[-1] = others / 256
    for (depth, context), i in kept.items():
        below = kept[depth - 1, context & ((1 << 8 * (depth - 1)) - 1)] if depth else None
        lower = probability[below] if depth else uniform
        count = np.append(merged[depth, context][alphabet], 0.0)
        n, distinct = count.sum(), int((count > 0).sum())
        if n == 0:
            probability[i] = lower
        else:
            rest = np.where(count > 0, 0.0, lower)
            left = rest.sum()
            escape = distinct / (n + distinct) if left > 0 else 0.0
            probability[i] = count / n * (1 - escape) + (rest * (escape / left) if left > 0 else 0.0)
        for column, byte in enumerate(alphabet):
            longer = (depth + 1, (context << 8) | int(byte))
            if depth < order and longer in kept:
                following[i, column] = kept[longer]
            elif depth:
                following[i, column] = following[below, column]
            else:
                following[i, column] = kept[0, 0]
        following[i, -1] = kept[0, 0]
    probability[:, -1] /= others
    return Automaton(order, code, np.log10(np.maximum(probability, 1e-30)).astype(np.float32), following)


def train(docs: DataFrame, order: int = 5, most_contexts: int = 80_000, least: int = 6) -> Automaton:
    """The automaton of the table's texts. Contexts seen less than ``least`` times are never kept."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    counted = docs.select("text").mapInArrow(_counted(order, buckets), "bucket int, grams binary, counts binary")
    nodes = counted.groupBy("bucket").applyInArrow(_contexts(order, least), "depth int, context long, total long, symbols binary, counts binary")
    nodes = materialize(nodes, "ppm-contexts")
    short = nodes.where("depth < 2").collect()
    deep = nodes.where("depth >= 2").orderBy(F.col("total").desc(), "depth", "context").limit(most_contexts).collect()
    return compile_trie([tuple(x) for x in [*short, *deep]], order)


#: Depth of the contexts whose probabilities are broadcast: there are at most 2^24 n-grams of them, whatever the corpus.
SHORT = 2


def _share(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Each n-gram's bucket: those with equal last three context bytes, thus all that share a longer context, are together."""
    return (mix((keys >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _planes(keys: np.ndarray) -> bytes:
    """Sorted numbers as byte planes of their differences, which compress well."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def next_depth(keys: np.ndarray, counts: np.ndarray, lower: np.ndarray, least: int) -> np.ndarray:
    """Probabilities of sorted n-grams of one depth, all successors of a context among them, from those of the depth below."""
    if not len(keys):
        return lower
    context = keys >> np.uint64(8)
    edge = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    size = np.diff(np.append(edge, len(keys)))
    seen = counts > 0
    n, distinct = np.add.reduceat(counts, edge).astype(np.float64), np.add.reduceat(seen, edge, dtype=np.int64)
    left = 1 - np.add.reduceat(np.where(seen, lower, 0.0), edge)
    open_ = left > 1e-15
    escape = np.where(open_, distinct / np.maximum(n + distinct, 1), 0.0)
    kept = np.repeat((n > 0) & (n >= least), size)
    longer = counts / np.repeat(np.maximum(n, 1), size) * (1 - np.repeat(escape, size))
    shorter = lower * np.repeat(np.where(open_, escape / np.where(open_, left, 1.0), 0.0), size)
    return np.where(kept, np.where(seen, longer, shorter), lower)


def probabilities(keys: np.ndarray, counts: np.ndarray, depths: range, least: int, below: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Of sorted n-grams, from the first of the depths, whose shorter ones are ``below`` (n-grams and probabilities), to the last."""
    held, p = below if below else (np.arange(256, dtype=np.uint64), np.full(256, 1 / 256))
    for k in depths:
        shorter = np.uint64((1 << (8 * (k + 1))) - 1)
        unique, inverse = np.unique(keys & shorter, return_inverse=True)
        total = np.bincount(inverse, counts, len(unique))
        lower = p[np.searchsorted(held, unique & np.uint64((1 << (8 * max(k, 1))) - 1))]
        held, p = unique, next_depth(unique, total, lower, least if k >= 2 else 1)
    return p[np.searchsorted(held, keys)]


#: Kinds of a chunk's entries.
WORDS, GRAMS, SHORTS = 0, 1, 2


def _shorts(table: pa.Table) -> pa.Table:
    columns = zip(table.column("words").to_pylist(), table.column("counts").to_pylist(), strict=True)
    keys, counts = _merge([(_from_planes(k), np.frombuffer(c, "<u4")) for k, c in columns])
    return pa.table([pa.array([keys.astype("<u8").tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["keys", "counts"])


def _gram_scores(shorts, order: int, least: int):
    """log10 of the probabilities of a bucket's n-grams, in each chunk's order."""

    def run(table: pa.Table) -> pa.Table:
        held = [_from_planes(x) for x in table.column("words").to_pylist()]
        counts = [np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]
        unique, inverse = np.unique(np.concatenate(held), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts), len(unique))
        score = np.log10(np.maximum(probabilities(unique, total, range(SHORT + 1, order + 1), least, shorts.value), 1e-30)).astype("<f4")
        back = np.split(score[inverse], np.cumsum([len(x) for x in held])[:-1])
        n = len(held)
        return pa.table([table.column("chunk").cast(pa.int64()), table.column("bucket").cast(pa.int32()), pa.nulls(n, pa.binary()), pa.array([x.tobytes() for x in back], pa.binary())], names=["chunk", "bucket", "words", "counts"])

    return run


def _vocabulary(buckets: int, order: int | None):
    """A chunk's distinct words and, if ``order`` is given, n-grams with their training counts."""
    names = ["kind", "bucket", "chunk", "words", "counts"]

    def run(table: pa.Table) -> pa.Table:
        chunk, parts, found = table.column("chunk")[0].as_py(), [], []
        for batch in table.to_batches():
            data, off = text_buffer(batch.column(batch.schema.get_field_index("text")))
            learn = ~np.array(batch.column(batch.schema.get_field_index("held_out")).to_pylist(), bool)
            for i, j in pieces(off):
                part = LOWER[data[off[i] : off[j]]]
                start, end, first = words(part, off[i : j + 1] - off[i])
                hashed, inverse = np.unique(RangeHash(part)(start, end), return_inverse=True)
                parts.append((hashed, np.bincount(inverse, np.repeat(learn[i:j], np.diff(first)), len(hashed)).astype(np.int64)))
                if order:
                    every, row = row_grams(data[off[i] : off[j]], off[i : j + 1] - off[i], order)
                    known = learn[i:j][row]
                    found.append(np.unique(every[known], return_counts=True))
                    new = np.unique(every[~known])
                    found.append((new, np.zeros(len(new), np.int64)))
                    if len(found) >= 8:
                        found = [_merge(found)]
        keys, counts = _merge(parts)
        out = [_entries(WORDS, keys, counts, bucket_edges(keys, buckets), lambda x: x.astype("<u8").tobytes())]
        if order:
            keys, counts = _merge(found)
            share = _share(keys, buckets)
            by = np.argsort(share, kind="stable")
            out.append(_entries(GRAMS, keys[by], counts[by], np.searchsorted(share[by], np.arange(buckets + 1)), _planes))
            keys, counts = _merge([(keys & np.uint64((1 << (8 * (SHORT + 1))) - 1), counts)])
            share = (mix(keys) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(share, kind="stable")
            out.append(_entries(SHORTS, keys[by], counts[by], np.searchsorted(share[by], np.arange(buckets + 1)), _planes))
        out = [x for part in out for x in part]
        columns = zip(*[(kind, b, chunk, k, c) for kind, b, k, c in out], strict=True) if out else [[]] * 5
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    return run


def _entries(kind: int, keys: np.ndarray, counts: np.ndarray, edges: np.ndarray, packed) -> list[tuple[int, int, bytes, bytes]]:
    return [(kind, b, packed(keys[x:y]), counts[x:y].astype("<u4").tobytes()) for b, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if x < y]


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, an equal range of hashes, begins among sorted hashes."""
    borders = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, borders), [len(keys)]])


def _totals(table: pa.Table) -> pa.Table:
    chunks, held = table.column("chunk").to_pylist(), [np.frombuffer(x, "<u8") for x in table.column("words").to_pylist()]
    counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in table.column("counts").to_pylist()]
    unique, inverse = np.unique(np.concatenate(held), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(unique)).astype(np.int64)
    back = np.split(total[inverse].astype("<i8"), np.cumsum([len(x) for x in held])[:-1])
    n, v = int(total.sum()), int((total > 0).sum())
    return pa.table([pa.array(chunks, pa.int64()), pa.array([x.tobytes() for x in held], pa.binary()), pa.array([x.tobytes() for x in back], pa.binary()), pa.array([n] + [0] * (len(held) - 1)), pa.array([v] + [0] * (len(held) - 1))], names=["chunk", "words", "counts", "n", "v"])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def gram_sums(texts: list[tuple[np.ndarray, np.ndarray]], values: list[tuple[int, bytes]], buckets: int, order: int) -> list[np.ndarray]:
    """The sum of each row's n-grams' values, piece by piece; values are given by bucket in the order of the chunk's n-grams."""
    found = []
    for raw, at in texts:
        unique, inverse = np.unique(row_grams(raw, at, order)[0], return_inverse=True)
        found.append((unique, inverse.astype(np.int32)))
    if not found:
        return []
    keys = np.zeros(0, np.uint64)
    for unique, _ in found:
        keys = np.union1d(keys, unique)
    value = np.empty(len(keys))
    value[np.argsort(_share(keys, buckets), kind="stable")] = np.frombuffer(b"".join(x for _, x in sorted(values)), "<f4")
    return [np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at) + 1), value[np.searchsorted(keys, unique)][inverse], len(at) - 1) for (unique, inverse), (_, at) in zip(found, texts, strict=True)]


def _score(shared, tokens: int, distinct: int, train_docs: int, buckets: int, order: int):
    """``shared``: the automaton, or None where n-grams' values come with the chunk."""
    total = tokens + train_docs
    base = np.log10(total + (distinct + (train_docs > 0) + 1.0))
    at_end = np.log10(train_docs + 1.0) - base
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        given = list(zip(known.column("bucket").to_pylist(), known.column("words").to_pylist(), known.column("counts").to_pylist(), strict=True))
        keys = [np.frombuffer(x, "<u8") for _, x, _ in given if x is not None]
        counts = [np.frombuffer(c, "<i8") for _, x, c in given if x is not None]
        values = [(b, c) for b, x, c in given if x is None]
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        by = np.argsort(key)
        key, count = key[by], (np.concatenate(counts) if counts else np.zeros(0, np.int64))[by]
        out, texts = [], []
        for batch in docs.to_batches():
            data, off = text_buffer(batch.column(batch.schema.get_field_index("text")))
            texts += [(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in pieces(off)]
        scores = iter(gram_sums(texts, values, buckets, order) if shared is None else [shared.value.score(*x) for x in texts])
        for batch in docs.to_batches():
            data, off = text_buffer(batch.column(batch.schema.get_field_index("text")))
            ids, held = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("held_out"))
            for i, j in pieces(off):
                raw, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                part = LOWER[raw]
                start, end, first = words(part, at)
                hashed, inverse = np.unique(RangeHash(part)(start, end), return_inverse=True)
                c = count[np.searchsorted(key, hashed)] if len(hashed) else np.zeros(0, np.int64)
                row, rows = np.repeat(np.arange(j - i), np.diff(first)), j - i
                n = np.diff(first) + 1
                n_known = np.bincount(row, (c > 0)[inverse], rows).astype(np.int64) + (train_docs > 0)
                base_score = np.bincount(row, (np.log10(c + 1.0) - base)[inverse], rows) + at_end
                out.append(pa.table([ids.slice(i, rows), held.slice(i, rows), pa.array(n, pa.int64()), pa.array(n_known), pa.array(np.full(rows, total, np.int64)), pa.array(base_score), pa.array(next(scores))], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)

    return run


def score(docs: DataFrame, held_out: F.Column, chunk_bytes: int = 24 << 20, order: int = 5, most_contexts: int | None = None, least: int = 6) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out: of all contexts, or of ``most_contexts``."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    stats = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("train")).first()
    model = None if most_contexts is None else spark.sparkContext.broadcast(train(rows.where("not held_out"), order, most_contexts, least))
    chunks = partitions_for(stats["bytes"], chunk_bytes, 1)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks).cast("long")))
    buckets = max(chunks, 8)
    vocabulary = dealt.select("chunk", "text", "held_out").groupBy("chunk").applyInArrow(_vocabulary(buckets, order if model is None else None), "kind int, bucket int, chunk long, words binary, counts binary")
    vocabulary = materialize(vocabulary, "chunk-counts")
    totals = materialize(vocabulary.where(f"kind = {WORDS}").groupBy("bucket").applyInArrow(_totals, "chunk long, words binary, counts binary, n long, v long"), "word-counts")
    sums = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    known = totals.select("chunk", F.lit(None).cast("int").alias("bucket"), "words", "counts")
    if model is None:
        found = vocabulary.where(f"kind = {SHORTS}").groupBy("bucket").applyInArrow(_shorts, "keys binary, counts binary").collect()
        keys, counts = _merge([(np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["counts"], "<i8")) for r in found] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))])
        shorts = spark.sparkContext.broadcast((keys, probabilities(keys, counts, range(SHORT + 1), least)))
        known = known.union(vocabulary.where(f"kind = {GRAMS}").groupBy("bucket").applyInArrow(_gram_scores(shorts, order, least), "chunk long, bucket int, words binary, counts binary"))
    run = _score(model, sums["n"], sums["v"], stats["train"], buckets, order)
    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, SCORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), F.pmod(crc_of_id(), F.lit(7)) == 2)
