"""Linear models over hashed text features: sparse rows, log-count ratios, dual coordinate descent, logistic fits.

Fits run on the driver over a sample whose row bound is a parameter of the callers;
scoring runs in Arrow batches and looks weights up before it removes repeats, so that
only features with a weight are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import BASE, LOWER, RangeHash, each_piece, mix, text_buffer, words

BITS = 20
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _bucket(hashes: list[np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    salted = [mix(h + np.uint64((k + 1) * int(BASE) % 2**64)) >> np.uint64(64 - BITS) for k, h in enumerate(hashes)]
    return np.concatenate(rows), np.concatenate(salted).astype(np.int64)


def word_and_stem_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket): lower-cased words without the punctuation around them, and their first 3 to 8 bytes."""
    data = LOWER[data]
    letter = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
    # Punctuation parts words here like white space does.
    start, end, first = words(np.where(letter, data, np.uint8(32)), off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    h = RangeHash(data)
    out, rows = [h(start, end)], [row]
    for k in range(3, 9):
        has = end - start >= k
        out.append(h(start[has], start[has] + k))
        rows.append(row[has])
    return _bucket(out, rows)


def word_and_form_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket): word unigrams and bigrams, word endings, and n-grams of word forms.

    A form says which letters, digits and signs a word has, its capitals, its length,
    and whether it repeats one of the words just before it.
    """
    start, end, first = words(data, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    n = len(start)
    h = RangeHash(data)
    word = h(start, end)
    count = lambda mask: (lambda s: s[end] - s[start])(np.concatenate([[0], np.cumsum(mask)]))
    upper, lower = count((data >= 65) & (data <= 90)), count(((data >= 97) & (data <= 122)) | (data >= 128))
    digit, sign = count((data >= 48) & (data <= 57)), count((data < 48) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 128)))
    size = end - start
    form = (upper > 0) + 2 * (upper > 1) + 4 * (lower > 0) + 8 * (digit > 0) + 16 * np.minimum(sign, 3) + 64 * (sign == size)
    back = lambda k: np.concatenate([np.zeros(min(k, n), bool), (word[k:] == word[:-k]) & (row[k:] == row[:-k])]) if n else np.zeros(0, bool)
    form = form + 128 * back(1) + 256 * (back(2) | back(3) | back(4))
    form = mix(form.astype(np.uint64))
    hashes, rows = [word, h(end - np.minimum(size, 2), end), h(end - np.minimum(size, 3), end), form], [row] * 4
    for source, widths in ((word, (2,)), (form, (2, 3, 4))):
        for width in widths:
            if n >= width:
                same = row[width - 1 :] == row[: n - width + 1]
                g = np.zeros(n - width + 1, np.uint64)
                for k in range(width):
                    g = g * BASE + source[k : n - width + 1 + k]
                hashes.append(g[same])
                rows.append(row[: n - width + 1][same])
    return _bucket(hashes, rows)


def distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << BITS) | bucket)
    return both >> BITS, both & ((1 << BITS) - 1)


def extract(df: DataFrame, features: Features, text: str = "text") -> DataFrame:
    """Adds the distinct feature numbers of a text as binary little-endian uint32, in place of the text."""
    keep = [c for c in df.columns if c != text]
    df = df.select(text, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in each_piece(batches, 0):
            row, bucket = distinct(*features(data, off))
            at = np.searchsorted(row, np.arange(len(off)))
            raw = bucket.astype("<u4")
            found = pa.array([raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], found], names=[*keep, "features"])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "features binary"]))


class Rows:
    """Sparse indicator rows: feature numbers of all rows in one array, with offsets.

    Work on all rows goes block by block, so that the driver holds the numbers and little more.
    """

    def __init__(self, index: np.ndarray, off: np.ndarray):
        self.index, self.off = index, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def take(self, which: np.ndarray) -> Rows:
        parts = [self.index[a:b] for a, b in zip(self.off[which].tolist(), self.off[which + 1].tolist(), strict=True)]
        return Rows(np.concatenate([self.index[:0], *parts]), np.concatenate([[0], np.cumsum(np.diff(self.off)[which])]))

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.off))

    def blocks(self, size: int = 256) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Rows, their feature numbers, and for each of those its row in the block."""
        for i in range(0, len(self), size):
            off = self.off[i : i + size + 1]
            yield slice(i, i + size), self.index[off[0] : off[-1]], np.repeat(np.arange(len(off) - 1), np.diff(off))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for rows, index, number in self.blocks():
            out[rows] = np.bincount(number, w[index], len(out[rows]))
        return out

    def limited(self, keep: np.ndarray) -> Rows:
        """The rows with the features alone that ``keep`` marks."""
        has = keep[self.index]
        return Rows(self.index[has], np.searchsorted(np.flatnonzero(has), self.off))


def log_count_ratios(rows: Rows, y: np.ndarray, smoothing: float = 1.0, least_rows: int = 3, least_ratio: float = 0.0) -> np.ndarray:
    """Per feature the log of its share in positive over its share in negative rows; 0 for rare or flat ones."""
    width = 1 << BITS
    pos, seen = np.zeros(width), np.zeros(width, np.int64)
    for part, index, number in rows.blocks():
        pos += np.bincount(index, y[part][number], width)
        seen += np.bincount(index, minlength=width)
    p, q = smoothing + pos, smoothing + seen - pos
    r = np.log(p / p[seen > 0].sum() if len(rows.index) else p) - np.log(q / q[seen > 0].sum() if len(rows.index) else q)
    r[(seen < least_rows) | (np.abs(r) < least_ratio)] = 0
    return r


def hinge_by_dual_coordinates(rows: Rows, scale: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + cost * sum hinge(y (w x + b)), x the scaled unit-length rows; y is 1 or -1.

    Each step solves one row's dual variable exactly within its box; the bias is the
    weight of a constant 1. Rare classes count as much as frequent ones.
    """
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    n, n_pos = len(rows), max(1, int((y > 0).sum()))
    box = np.where(y > 0, cost * n / (2 * n_pos), cost * n / (2 * max(1, n - n_pos)))
    parts = []
    for i in range(n):
        idx = rows.index[rows.off[i] : rows.off[i + 1]]
        idx = idx[scale[idx] != 0]
        x = scale[idx]
        norm = np.sqrt(x @ x)
        parts.append((idx, x / norm if norm else x, (1.0 if norm else 0.0) + 1.0))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(n):
            idx, x, q = parts[i]
            gradient = y[i] * (w[idx] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / q, 0.0), box[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[idx] += step * x
                bias += step
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, bias


def margins(rows: Rows, scale: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    norm = np.sqrt(rows.dot(scale**2))
    return rows.dot(scale * w) / np.where(norm > 0, norm, 1.0) + bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(dense: np.ndarray, rows: Rows | None, scale: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the dense columns and of the scaled sparse features of a ridge logistic fit, by Adam over all rows."""
    n = max(1, len(y))
    d, w = np.zeros(dense.shape[1]), np.zeros(len(scale) if rows is not None else 0)
    if rows is not None:
        used, inverse = np.unique(rows.index, return_inverse=True)
        numbers, s = rows.row_numbers(), scale[rows.index]
    else:
        used, inverse, numbers, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    v = np.zeros(len(used))
    state = [np.zeros(len(d) + len(v)), np.zeros(len(d) + len(v))]
    weight = np.where(y > 0, n / (2 * max(1.0, y.sum())), n / (2 * max(1.0, n - y.sum()))) ** 0.5
    for t in range(1, rounds + 1):
        z = dense @ d + np.bincount(numbers, v[inverse] * s, len(y))
        g = (sigmoid(z) - y) * weight / n
        grad = np.concatenate([dense.T @ g, np.bincount(inverse, g[numbers] * s, len(v)) + ridge * v / n])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        step = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-9)
        d -= step[: len(d)]
        v -= step[len(d) :]
    w[used] = v
    return d, w


def crc_of_id(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_columns: list[str], most_rows: int, features: Features, where: F.Column | None = None) -> tuple[Rows, np.ndarray]:
    """Features and labels of at most ``most_rows`` labelled documents, the first in a hash order.

    Repeated labels of a document count once, by the largest; rows without a label are left out.
    The sample's ids, which that bound keeps small, are broadcast.
    """
    rows = labels if where is None else labels.where(where)
    rows = rows.where(" and ".join(f"{c} is not null" for c in ["doc_id", *label_columns]))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(c).cast("int").alias(c) for c in label_columns])
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")
    table = extract(texts, features).toArrow().sort_by("doc_id").combine_chunks()
    y = np.array([table.column(c).to_numpy(zero_copy_only=False) for c in label_columns], float).reshape(len(label_columns), -1)
    data, off = text_buffer(pa.concat_arrays([pa.array([], table.schema.field("features").type), *table.column("features").chunks]))
    return Rows(data[off[0] : off[-1]].view("<u4"), (off - off[0]) // 4), y
