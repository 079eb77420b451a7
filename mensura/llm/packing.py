"""Packing (8): first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents are tokenized and cut into full sequences plus a remainder. Remainders meet
in groups of a fixed expected size, chosen by a hash of doc_id, so no key can gather
rows; each group is packed on its own by first-fit decreasing, with a tournament tree
that finds the first bin with room in O(log bins). As documents may be cut freely, the
emptiest bins then fill the gaps of the others, and the one that is left is cut at
powers of two, where sequences need no padding.

Null and empty texts have the end token alone. Repeated rows are packed as often as
they occur. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import SPACE, RangeHash, doc_columns, each_piece, lean, partitions_for, read, ship_package

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Byte pairs that begin white space outside ASCII; texts with them are tokenized whole.
WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")
#: Bytes of text whose units are looked up together.
TOKENIZE_BYTES = 2 << 20
#: Units that a worker's memory may have, about 40 bytes each; it starts anew beyond them.
KNOWN_UNITS = 1_500_000
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: ASCII marks but the apostrophe, with which contractions begin.
MARK = np.zeros(256, bool)
MARK[[x for x in range(33, 127) if not ALNUM[x] and x != 39]] = True
#: Units that stand in one string for the tokenizer, apart by its special token.
UNITS_TOGETHER = 512
#: Such strings that are encoded at a time: an encoding takes a hundred bytes and more a token.
STRINGS_TOGETHER = 64
#: A worker's tokenizers by path, kept from task to task.
_tokenizers: dict[str, UnitTokenizer] = {}


class UnitTokenizer:
    """Byte-level BPE by units: white space runs but for their last character, and that character with the word after it.

    A word is cut once more where ASCII letters or digits meet ASCII marks but the apostrophe.
    The pre-tokenizer's pattern never matches across these borders, so the ids are
    those of the whole text, and each distinct unit is encoded once. Units go
    to the tokenizer many in a string, apart by a special token, which it always splits
    off first; where a text has that token's name, units go one by one, as ordinary text.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.splitter = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        added = self.splitter.get_added_tokens_decoder().items()
        plain = [(i, x.content.encode()) for i, x in added if x.special and not (x.lstrip or x.rstrip or x.single_word)]
        self.apart = plain[0] if plain and len(added) == 1 else None
        self._forget()

    def _forget(self) -> None:
        #: Hashes of known units in order, and of each where its ids begin in ``flat`` and how many they are.
        self.keys, self.begins, self.lengths, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_units(self, units: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """All units' ids and how many each has; ``plain``: no text has a special token's name."""
        if not (plain and self.apart):
            found = self.encode([x.decode() for x in units])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.int64, lengths.sum()), lengths
        apart, name = self.apart
        texts = [name.join([*units[i : i + UNITS_TOGETHER], b""]).decode() for i in range(0, len(units), UNITS_TOGETHER)]
        batches = (self.splitter.encode_batch_fast(texts[i : i + STRINGS_TOGETHER], add_special_tokens=False) for i in range(0, len(texts), STRINGS_TOGETHER))
        parts = [np.array(x.ids, np.int64) for found in batches for x in found]
        ids = np.concatenate([*parts, np.zeros(0, np.int64)])
        at = np.flatnonzero(ids == apart)
        return ids[ids != apart], np.diff(at, prepend=-1) - 1

    def __call__(self, data: np.ndarray, off: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, each row ending in ``end``, and the rows' offsets."""
        n, rows = len(data), len(off) - 1
        raw = data.tobytes()
        space = SPACE[data]
        first = np.zeros(n + 1, bool)
        first[off] = True
        border = first[:n].copy()
        if n > 1:
            border[1:] |= space[1:] & ~space[:-1]
            border[:-1] |= space[:-1] & ~space[1:] & ~first[1:n]
            border[1:] |= MARK[data[1:]] & ALNUM[data[:-1]]
        start = np.flatnonzero(border)
        unit_end = np.append(start[1:], n)
        hashed = RangeHash(data)(start, unit_end) if n else np.zeros(0, np.uint64)
        unique, where, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_UNITS:
            self._forget()
        place = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        new[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] != unique[place < len(self.keys)]
        at = where[new]
        units = [raw[a:b] for a, b in zip(start[at].tolist(), unit_end[at].tolist(), strict=True)]
        ids, count = self.encode_units(units, not self.apart or self.apart[1] not in raw)
        self.begins = np.insert(self.begins, place[new], len(self.flat) + np.cumsum(count) - count)
        self.lengths = np.insert(self.lengths, place[new], count)
        self.keys, self.flat = np.insert(self.keys, place[new], unique[new]), np.concatenate([self.flat, ids.astype(np.uint32)])
        place = np.searchsorted(self.keys, unique)
        flat = np.append(self.flat, np.uint32(end))
        begins, lengths = np.append(self.begins[place], len(self.flat)), np.append(self.lengths[place], 1).astype(np.int64)
        # The end token is one more unit of each row.
        units_before = np.searchsorted(start, off)
        sequence = np.insert(inverse, units_before[1:], len(unique))
        count = lengths[sequence]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(begins[sequence] - total[:-1], count) + np.arange(total[-1])]
        row_off = total[units_before + np.arange(rows + 1)]
        if any(x in raw for x in WIDE_SPACE):
            whole = [i for i in range(rows) if any(x in raw[off[i] : off[i + 1]] for x in WIDE_SPACE)]
            if whole:
                parts = np.split(ids, row_off[1:-1])
                for i, x in zip(whole, self.encode([raw[off[i] : off[i + 1]].decode() for i in whole]), strict=True):
                    parts[i] = np.array([*x, end], np.int64)
                ids, row_off = np.concatenate(parts).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, row_off


def _tokenized(path: str, size: int):
    out = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("rest", pa.binary())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = UnitTokenizer(path)
        tokenizer = _tokenizers[path]
        for rows, data, off in each_piece(batches, 1, TOKENIZE_BYTES):
            ids, at = tokenizer(data, off)
            ids = ids.astype("<u4")
            crcs, rest = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                cut = b - (b - a) % size
                crcs.append([zlib.crc32(ids[i : i + size].tobytes()) for i in range(a, cut, size)])
                rest.append(ids[cut:b].tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary())], schema=out)

    return run


class TournamentTree:
    """Bins' free room as leaves, each inner node the most room below it; finds the first bin with room enough."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        k, most = 1, self.most
        while k < self.leaves:
            k *= 2
            if most[k] < need:
                k += 1
        most[k] -= need
        leaf = k
        while k > 1:
            k //= 2
            most[k] = max(most[2 * k], most[2 * k + 1])
        return leaf - self.leaves


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length) where every item is whole; sizes are 1 to room, ties in order."""
    tree, bins = TournamentTree(len(sizes), room), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = tree.first_fit(sizes[i])
        if k == len(bins):
            bins.append([])
        bins[k].append((i, 0, sizes[i]))
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], room: int) -> list[list[tuple[int, int, int]]]:
    """Cuts what is in the emptiest bins into the gaps of the fuller ones, then the last bin at powers of two."""
    full = [b for b in bins if sum(x[2] for x in b) == room]
    open_ = sorted((b for b in bins if sum(x[2] for x in b) < room), key=lambda b: -sum(x[2] for x in b))
    lo, hi = 0, len(open_) - 1
    while lo < hi:
        gap = room - sum(x[2] for x in open_[lo])
        while gap and lo < hi:
            if not open_[hi]:
                hi -= 1
                continue
            item, start, length = open_[hi].pop()
            take = min(gap, length)
            open_[lo].append((item, start + length - take, take))
            if take < length:
                open_[hi].append((item, start, length - take))
            gap -= take
        if not gap:
            lo += 1
    full += [b for b in open_[:lo] if b]
    for b in open_[lo : hi + 1]:
        left = sum(x[2] for x in b)
        while left:
            part, need = [], min(room, 1 << (left.bit_length() - 1))
            left -= need
            while need:
                item, start, length = b.pop(0)
                take = min(need, length)
                part.append((item, start, take))
                if take < length:
                    b.insert(0, (item, start + take, length - take))
                need -= take
            full.append(part)
    return full


def _pack_group(size: int):
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("rest", "ascending")])
        group = table.column("g")[0].as_py()
        docs, tokens = table.column("doc_id").to_pylist(), table.column("doc_tokens").to_pylist()
        rest = [np.frombuffer(x, "<u4") for x in table.column("rest").to_pylist()]
        rows, sequence = [], group << 32
        for doc, n, crcs in zip(docs, tokens, table.column("crcs").to_pylist(), strict=True):
            for k, crc in enumerate(crcs):
                rows.append((doc, k * size, size, crc, n, sequence, 0))
                sequence += 1
        some = [i for i, x in enumerate(rest) if len(x)]
        for members in fill_gaps(first_fit_decreasing([len(rest[i]) for i in some], size), size):
            offset = 0
            for k, start, length in members:
                i = some[k]
                rows.append((docs[i], tokens[i] - len(rest[i]) + start, length, zlib.crc32(rest[i][start : start + length].tobytes()), tokens[i], sequence, offset))
                offset += length
            sequence += 1
        return pa.table([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, group_docs: int = 2000, seed: int = 8) -> DataFrame:
    """Pieces of the documents in sequences of at most ``size`` tokens.

    ``group_docs`` is the expected number of documents of a group; the number of groups follows the table's.
    """
    ship_package(docs.sparkSession)
    groups = partitions_for(docs.count(), group_docs)
    schema = "doc_id long, doc_tokens long, crcs array<long>, rest binary"
    pieces = doc_columns(docs).mapInArrow(_tokenized(tokenizer_path, size), schema)
    keyed = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(seed), "doc_tokens", F.crc32("rest")), F.lit(groups)))
    return keyed.groupBy("g").applyInArrow(_pack_group(size), PIECE_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
