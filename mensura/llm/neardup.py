"""MinHash near-dedup (7) over SetSketch registers.

Each document's set of 5-word shingles is sketched by exponentially spaced, truncated
minima (SetSketch: register = floor(1 - log_b of the least exponential variate)), which
merge by maximum. Documents with equal sets are one class. Bands of three registers make
candidate buckets; a pair's similarity is first estimated jointly by maximum likelihood
from its registers and exact set sizes, then confirmed on the full sets.

A bucket's members are first compared with its least member (a star). Only buckets that
the confirmed links leave in several components are compared further, and there only
members of different components, in blocks of rows whose sets lie side by side: nothing
but links leaves a block, and copies are never expanded into all pairs.
With 32 bands of 3, a pair at similarity 0.75 shares no band with probability 2.4e-8.

Null and empty texts, and texts without words, have empty sets: they link with nothing and
are kept. A node is a class of equal sets, whatever its rows' ids: texts that share an id, or have
none, are apart. Of a component the least (doc_id, text hash) is kept, ids before null. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import BASE, LOWER, RangeHash, beside, doc_columns, each_piece, lean, materialize, mix, read, shingles, ship_package, words
from mensura.llm.graph import components

BANDS, ROWS = 32, 3
REGISTERS = BANDS * ROWS
#: SetSketch's base, rate and limit: 16-bit registers for sets of up to 10^18 elements.
B, A, Q = 1.001, 20.0, 2**16 - 2
#: Of the shingle hashes, the bits that make a set's elements; equal in all uses.
ELEMENT_BITS = 48
#: Members of a block of an undecided bucket.
BLOCK = 512
_multipliers = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * BASE) | np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingles as sorted 48-bit numbers, and the rows' offsets."""
    data = LOWER[data]
    start, end, first = words(data, off)
    found, at = shingles(RangeHash(data)(start, end), first)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(at))
    both = np.unique((row << np.uint64(ELEMENT_BITS)) | (found >> np.uint64(64 - ELEMENT_BITS)))
    edges = np.searchsorted(both, np.arange(len(off), dtype=np.uint64) << np.uint64(ELEMENT_BITS))
    return both & np.uint64((1 << ELEMENT_BITS) - 1), edges


def registers(elements: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """SetSketch registers of nonempty rows, a line each: exponential minima, truncated on a scale of powers of b."""
    some = np.flatnonzero(np.diff(edges) > 0)
    out = np.zeros((len(edges) - 1, REGISTERS), np.uint16)
    if not len(some):
        return out
    spread, begin = mix(elements + BASE), edges[:-1][some]
    least = np.empty((len(some), REGISTERS), np.uint64)
    for k in range(REGISTERS):
        least[:, k] = np.minimum.reduceat((spread * _multipliers[k]) ^ (spread >> np.uint64(29)), begin)
    variate = -np.log1p(-np.minimum(least.astype(np.float64) / 2.0**64, 1 - 2.0**-53)) / A
    out[some] = np.clip(np.floor(1 - np.log(np.maximum(variate, 1e-300)) / np.log(B)), 0, Q + 1).astype(np.uint16)
    return out


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 101)


def joint_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from their registers, a line each, and set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    possible = np.minimum(u / v, v / u) >= _GRID - 1e-9
    up, down = np.clip(p(u - v * _GRID), 1e-12, 1), np.clip(p(v - u * _GRID), 1e-12, 1)
    value = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))
    return _GRID[np.where(possible, value, -np.inf).argmax(1)]


SIGNED = "doc_id long, h long, n long, k1 long, k2 long, regs binary, bands array<long>"


@lean
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in each_piece(batches, 1):
        elements, edges = shingle_sets(data, off)
        regs = registers(elements, edges)
        lanes = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
        band = mix(((lanes[:, :, 0] << np.uint64(32)) | (lanes[:, :, 1] << np.uint64(16)) | lanes[:, :, 2]) * BASE + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
        raw = elements.astype("<u8")
        keys = np.array([np.frombuffer(hashlib.blake2b(raw[a:b], digest_size=16).digest(), "<i8") for a, b in zip(edges[:-1], edges[1:], strict=True)]).reshape(-1, 2)
        n = len(off) - 1
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.diff(edges), pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([x.tobytes() for x in regs], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band.ravel()))], names=["doc_id", "h", "n", "k1", "k2", "regs", "bands"])


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in each_piece(batches, 1):
        elements, edges = shingle_sets(data, off)
        six = elements.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].copy()
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([six[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["node", "elements"])


def _likely(threshold: float):
    """Keeps pairs whose estimated similarity isn't clearly under what is asked."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 8192):
                part = batch.slice(i, 8192)
                na, nb = part.column(2).to_numpy(), part.column(3).to_numpy()
                lines = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(part), -1)
                has = joint_similarity(lines(part.column(4)), lines(part.column(5)), na, nb) >= threshold
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(has)) for k in (0, 1)], names=["a", "b"])

    return run


def _confirmed(share: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has, last = [], (None, None)
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if last[0] != a:
                    last = (a, _numbers(x.as_py()))
                p, q = last[1], _numbers(y.as_py())
                common = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                has.append(100 * common >= share * (len(p) + len(q) - common))
            mask = pa.array(has, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], names=["a", "b"])

    return run


def _numbers(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return np.hstack([six, np.zeros((len(six), 2), np.uint8)]).view("<u8").ravel()


def common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets: a product of their incidence matrix for many pairs, part by part."""
    if len(i) <= 4 * len(sets):
        return np.array([len(sets[x]) + len(sets[y]) - len(np.unique(np.concatenate([sets[x], sets[y]]))) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    has = count[column] > 1
    row, column = row[has], np.unique(column[has], return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        x, y = np.searchsorted(column, [c, c + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[x:y], column[x:y] - c] = 1
        total += part @ part.T
    return total[i, j].astype(np.int64)


def _across(threshold: float, share: int):
    """Links between different components inside (bucket, block, block) groups that lie sorted in the partition.

    A pair is tried where its registers first agree in a band, and there only.
    """

    def links(t: pa.Table) -> pa.RecordBatch:
        k, bi, bj, band, block, node, comp, rep, n = (t.column(c).to_numpy() for c in ("k", "bi", "bj", "band", "block", "node", "component", "rep", "n"))
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(len(t), -1)
        raw = t.column("elements").to_pylist()
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]), [True]]))
        out = [np.zeros((2, 0), np.int64)]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            left, right = [], []
            for x in range(a, b - 1, 64):  # lines of the triangle, few at a time
                i = np.repeat(np.arange(x, min(x + 64, b - 1)), b - 1 - np.arange(x, min(x + 64, b - 1)))
                j = np.concatenate([np.arange(y + 1, b) for y in range(x, min(x + 64, b - 1))])
                has = (comp[i] != comp[j]) & (node[i] != rep[i]) & (node[j] != rep[j]) & (100 * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])) & ((bi[i] == bj[i]) | (block[i] != block[j]))
                i, j = i[has], j[has]
                if len(i):
                    same = regs[i] == regs[j]
                    has = (same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[i]) & (same.sum(1) >= REGISTERS * (threshold - 0.1))
                    i, j = i[has], j[has]
                if len(i):
                    has = joint_similarity(regs[i], regs[j], n[i], n[j]) >= threshold
                    left.append(i[has])
                    right.append(j[has])
            i, j = np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])
            if len(i):
                used, inverse = np.unique(np.concatenate([i, j]), return_inverse=True)
                common = common_counts([_numbers(raw[x]) for x in used], inverse[: len(i)], inverse[len(i) :])
                has = 100 * common >= share * (n[i] + n[j] - common)
                out.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])])[:, has])
        found = np.unique(np.concatenate(out, 1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += len(batch)
            if rows >= 4 * BLOCK:
                t = pa.concat_tables(held).combine_chunks()
                keys = [t.column(c).to_numpy() for c in ("k", "bi", "bj")]
                same = np.logical_and.reduce([x == x[-1] for x in keys])
                cut = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield links(t.slice(0, cut))
                held, rows = [t.slice(cut)], len(t) - cut
        if rows:
            yield links(pa.concat_tables(held).combine_chunks())

    return run


class NearDuplicates:
    """The stages of one run; every intermediate table lies in the shared folder."""

    def __init__(self, docs: DataFrame, share: int = 75, estimate: float = 0.5):
        ship_package(docs.sparkSession)
        self.docs, self.share, self.estimate = doc_columns(docs).withColumn("h", F.xxhash64("text")), share, estimate
        self.signed = materialize(self.docs.mapInArrow(_signed, SIGNED), "signatures")

    def run(self) -> DataFrame:
        full = self.signed.where("n > 0")
        classes = materialize(full.groupBy("k1", "k2").agg(F.expr("min(named_struct('none', doc_id is null, 'doc_id', doc_id, 'h', h))").alias("least"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")).withColumn("node", F.col("k1")), "classes")
        nodes = classes.select("node", "n", "regs")
        bands = classes.select("node", F.posexplode("bands").alias("band", "k"))
        buckets = bands.groupBy("k").agg(F.min("node").alias("rep"), F.count("*").alias("members")).where("members > 1")
        rows = materialize(bands.join(buckets, "k"), "buckets")
        stars = rows.where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
        likely = materialize(self._likely(stars, nodes), "likely-stars")
        sets = self._set_table(rows, classes)
        links = materialize(self._confirm(likely, sets, "links"), "links")
        parts = materialize(components(links), "components")
        found = materialize(self._across(rows, nodes, sets, parts), "links-across")
        of = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        joined = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
        joined = materialize(joined, "joined")
        if joined.isEmpty():
            final = parts
        else:
            above = components(joined).select(F.col("node").alias("component"), F.col("component").alias("top"))
            # A node may lie in no component of the first round but in one of the second.
            known = parts.union(joined.select("a", "a")).union(joined.select("b", "b")).distinct()
            final = known.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component")).distinct()
        self.links = links.union(found)
        of_class = classes.select("k1", "k2", "node", "least").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
        first = of_class.groupBy("component").agg(F.min("least").alias("first"))
        out = self.signed.join(of_class.join(first, "component").select("k1", "k2", "first"), ["k1", "k2"], "left")
        some = F.col("n") > 0
        component = F.when(some, F.col("first.doc_id")).otherwise(F.col("doc_id"))
        kept = F.when(some, F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h"))).otherwise(F.lit(True))
        return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "h")

    def _likely(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
        b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
        near = pairs.join(b, "b").join(a, "a").where(f"100 * least(na, nb) >= {self.share} * greatest(na, nb)")
        return near.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_likely(self.estimate), "a long, b long")

    def _set_table(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """The sets of all nodes that share a bucket with another, from the text of each class's least row."""
        wanted = classes.join(rows.select("node").distinct(), "node", "left_semi").select("node", F.col("least.doc_id").alias("_id"), F.col("least.h").alias("_h"))
        texts = self.docs.join(wanted, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text").dropDuplicates(["node"])
        return materialize(texts.mapInArrow(_sets, "node long, elements binary"), "sets")

    def _confirm(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        a, b = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
        return materialize(pairs.join(b, "b").join(a, "a").select("a", "b", "ea", "eb").mapInArrow(_confirmed(self.share), "a long, b long"), name)

    def _across(self, rows: DataFrame, nodes: DataFrame, sets: DataFrame, parts: DataFrame) -> DataFrame:
        rows = rows.where("members > 2").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = rows.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("k")
        rows = rows.join(open_, "k").join(nodes.join(sets, "node"), "node")
        blocks = F.ceil(F.col("members") / BLOCK)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        rows = rows.select("k", "bi", "bj", "band", "block", "node", "component", "rep", "n", "regs", "elements").repartition("k", "bi", "bj").sortWithinPartitions("k", "bi", "bj")
        return rows.mapInArrow(_across(self.estimate, self.share), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, share: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    return NearDuplicates(docs, share).run().drop("h")


@beside("doc_id", "text")
def one_of_each(docs: DataFrame, share: int = 75) -> DataFrame:
    """The documents, with their columns, that are their component's kept rows; of rows equal in id and text one."""
    found = NearDuplicates(docs, share).run().where("kept").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    rows = docs.withColumn("_text", F.xxhash64("text"))
    rows = rows.join(found, (F.col("_text") == F.col("_h")) & docs["doc_id"].cast("long").eqNullSafe(F.col("_id")))
    return rows.drop("_id", "_h", "_text").dropDuplicates(["doc_id", "text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
