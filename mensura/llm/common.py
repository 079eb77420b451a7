"""What the operators of this subpackage share: durable intermediate tables and work on Arrow buffers.

A text column is handled as one byte buffer with row offsets, so that numpy sees
whole batches; a null text counts as empty everywhere.
"""

from __future__ import annotations

import ctypes
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one pass of numpy handles, so that its temporaries stay in the CPU's cache.
PIECE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder is set, which serves a local master alone; on a cluster it is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not on_one_machine(spark):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", place)
        spark.sparkContext.setCheckpointDir(place)
    return place


#: Where materialize() has written since the last release().
_written: list[str] = []
#: Applications whose workers have the package.
_shipped: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: later jobs neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables written so far; only for callers whose results so far are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def on_one_machine(spark: SparkSession) -> bool:
    """Whether the driver itself runs the tasks, so that they see its folders."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import the package: from where the driver did on one machine, else from an archive that Spark hands out, once a session."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if not on_one_machine(spark):
        app = spark.sparkContext.applicationId
        if app not in _shipped:
            place = tempfile.mkdtemp(prefix="package-")
            spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(place, "mensura"), "zip", root, "mensura"))
            _shipped.add(app)
        return
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def trim_memory() -> None:
    """Gives the memory that this Python worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def lean(run: Callable) -> Callable:
    """A partition's function that trims the worker at its end: Spark hands workers from stage to stage, with all they hold."""

    @functools.wraps(run)
    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim_memory()

    return trimmed


def beside(*own: str) -> Callable:
    """For a stage that returns the documents' columns: all but ``own`` pass through under names that clash with none of the stage's."""

    def wrap(stage: Callable) -> Callable:
        @functools.wraps(stage)
        def run(docs: DataFrame, *args, **named) -> DataFrame:
            hidden = {c: f"_beside{i}" for i, c in enumerate(docs.columns) if c not in own}
            out = stage(docs.withColumnsRenamed(hidden), *args, **named)
            return out.withColumnsRenamed({v: k for k, v in hidden.items()})

        return run

    return wrap


def partitions_for(n: int, each: int, least: int = 1) -> int:
    return max(least, -(-n // each))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its row offsets."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), off


def pieces(off: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone, whole."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, min(int(np.searchsorted(off, off[i] + limit, "right")) - 1, i + 32_768))
        yield i, j
        i = j


def each_piece(batches: Iterator[pa.RecordBatch], text: int, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets from 0) of pieces of the batches; ``text`` is the text column's index."""
    for batch in batches:
        data, off = text_buffer(batch.column(text))
        for i, j in pieces(off, limit):
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]


def _fixed_table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_CODE = _fixed_table()
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class RangeHash:
    """64-bit polynomial hashes of byte ranges of one buffer; equal bytes have equal hashes in any buffer.

    Powers are kept for buffers of up to two pieces; a longer one has its own.
    """

    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(self.up) <= len(data):
            size = next((k * PIECE_BYTES for k in (1, 2) if len(data) <= k * PIECE_BYTES), len(data))
            self.up, self.down = powers(BASE, size), powers(BASE_INVERSE, size)
            if size <= 2 * PIECE_BYTES:
                RangeHash.up, RangeHash.down = self.up, self.down
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * self.up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and each row's first word in them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, inside
    after = np.empty(n + 1, bool)
    after[n], after[:n] = False, inside
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return start, end, np.searchsorted(start, off)


def shingles(word: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each row and the rows' offsets; a row of fewer words has one run, of all."""
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(runs)])
    full = count >= width
    out = np.empty(off[-1], np.uint64)
    if full.any():
        r = runs * full
        at = np.repeat(first[:-1] - (np.cumsum(r) - r), r) + np.arange(r.sum())
        h = np.zeros(len(at), np.uint64)
        for k in range(width):
            h = h * BASE + word[at + k]
        out[np.repeat(off[:-1] - (np.cumsum(r) - r), r) + np.arange(r.sum())] = mix(h)
    short = np.flatnonzero(~full & (count > 0))
    h = count[short].astype(np.uint64)
    for k in range(width - 1):
        has = count[short] > k
        h[has] = h[has] * BASE + word[first[short[has]] + k]
    out[off[short]] = mix(h)
    return out, off


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_columns(docs: DataFrame) -> DataFrame:
    """The identifier and the text alone, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
