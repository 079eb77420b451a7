"""Document fingerprints (2): threshold-scaled sketches, in DataFrame operations only.

A sketch holds every shingle hash under a fixed fraction of the hash range, so its size
follows the document's: sketches of very unequal documents stay comparable (containment),
and a union's sketch is the union of sketches. Shingles are of five words; a text of fewer
words is one shingle. Where no hash lies under the fraction, the least one stands in, so
that only texts without words have empty sketches.

Null and empty texts have empty sketches; two empty sketches are alike (1), an empty and
another one are not (0). Repeated rows stand next to each other in the order. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.llm.common import doc_columns, partitions_for, read

WORD = r"[^\x20\x09-\x0D]+"
#: The part of all shingle hashes that a sketch keeps.
FRACTION = 0.25


def with_sketch(df: DataFrame, text: str, name: str, fraction: float = FRACTION, width: int = 5) -> DataFrame:
    """Adds the sorted kept hashes of a text column as an array of long."""
    limit = -(2**63) + int(2**64 * fraction)
    df = df.withColumn("_words", F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), 0), lambda w: F.xxhash64(w)))
    at = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(width)])
    n = F.size("_words")
    df = df.withColumn("_all", F.when(n >= width, F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), at)).when(n > 0, F.array(F.xxhash64("_words"))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_kept", F.array_sort(F.array_distinct(F.filter("_all", lambda h: h < limit))))
    return df.withColumn(name, F.when((F.size("_kept") == 0) & (F.size("_all") > 0), F.array(F.array_min("_all"))).otherwise(F.col("_kept"))).drop("_words", "_all", "_kept")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the shingle sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first's shingles that the second has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def printed(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.hex(F.shiftrightunsigned(h, 16))), ",")


def _block(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie under the value, by two short scans."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    under = lambda a: F.size(F.filter(a, lambda x: x < value))
    lasts = F.array(*[F.lit(c[-1]).cast("long") for c in chunks])
    nested = F.array(*[F.array(*[F.lit(x).cast("long") for x in c]) for c in chunks])
    skipped = under(lasts)
    return F.least(skipped * step + F.coalesce(under(F.get(nested, skipped)), F.lit(0)), F.lit(len(bounds)))


def with_next(docs: DataFrame, sketch: str = "sketch", block_docs: int = 1000, most_blocks: int = 20_000) -> DataFrame:
    """Each document with the text and the sketch of the next by descending doc_id; the first follows the last.

    Blocks of neighbouring ids, by exact ids at quantiles, are shuffled once. The largest
    id of a block also goes to the block before it in ascending order's successor, as the
    row that ends it, so no window spans the table and no block waits for another.
    """
    stats = docs.agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).first()
    blocks = min(most_blocks, partitions_for(stats["n"], block_docs))
    bounds = []
    if blocks > 1:
        quantiles = F.percentile_approx("doc_id", F.array(*[F.lit(k / blocks) for k in range(1, blocks)]), max(10_000, 4 * blocks))
        bounds = sorted(x for x in set(docs.agg(quantiles.alias("q")).first()["q"]) if x != stats["top"])
    own = F.coalesce(_block(F.col("doc_id"), bounds), F.lit(0))
    following = F.when(F.col("doc_id") == F.lit(stats["top"]), F.lit(0)).when(_is_bound(F.col("doc_id"), bounds), own + 1)
    places = F.array_compact(F.array(F.struct(own.alias("block"), F.lit(False).alias("guard")), F.when(following.isNotNull(), F.struct(following.alias("block"), F.lit(True).alias("guard")))))
    rows = docs.withColumn("_at", F.explode(places)).select("doc_id", "text", F.col("_at.block").alias("block"), F.col("_at.guard").alias("guard")).repartition("block")
    rows = with_sketch(rows, "text", sketch)
    order = Window.partitionBy("block").orderBy("guard", F.col("doc_id").desc_nulls_last(), "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn(f"next_{sketch}", F.lead(sketch).over(order)).where(~F.col("guard")).drop("block", "guard")


def _is_bound(value: Column, bounds: list[int]) -> Column:
    at = _block(value, bounds)
    if not bounds:
        return F.lit(False)
    step = math.isqrt(len(bounds)) + 1
    nested = F.array(*[F.array(*[F.lit(x).cast("long") for x in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    return F.coalesce(F.get(F.get(nested, F.floor(at / step).cast("int")), (at % step).cast("int")) == value, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_columns(read(spark, sf_dir, "documents")).withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_next(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next_text", third))
    rows = rows.withColumn("edited", F.when(third > 0, edited).otherwise(F.col("text")))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
