"""Mixing sources to target weights (9): a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule: weights at knots of the training time 0 to 1, linear
in between. Its integral gives the source's share of the tokens; shares that would repeat
a source too often stop at a multiple of its size and the excess goes to the others.
Within a source documents stand in hash order; a document's cumulated words, scaled to
the target, are its share of the source's demand, and the inverse of the source's
cumulated demand is its position in training. Positions range-sort the documents.

Cumulated sums are taken in two steps (hash buckets of a source, then documents of a
bucket), so a source with a third of all rows is spread over many tasks.

Null sources are one source, the last. Null texts have size 0 and are never taken.
Repeated rows count each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.llm.common import beside, materialize, partitions_for, read

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order, repeating.
CYCLE = (1, 2, 3)


def source_targets(sizes: DataFrame, most_repeats: int = 3, weight: F.Column | None = None) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): shares by weight, none over most_repeats times its size.

    Sources in order of size to weight reach their limit first, so the limited ones are
    a beginning of that order, and the level that the others share follows from its sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = weight if weight is not None else F.element_at(F.array(*map(F.lit, CYCLE)), ((F.row_number().over(order) - 1) % len(CYCLE) + 1).cast("int"))
    w = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumns({
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "shared": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # The first source that stays under its limit when it and all later ones share what is left.
    w = w.withColumn("level", F.when(F.col("left") * F.col("weight") <= F.col("cap") * F.col("shared"), F.col("left") / F.col("shared")))
    w = w.withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return w.select("source", "source_size", "weight", target.alias("target"))


def word_sizes(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep)


def inverse_demand(share: F.Column, schedule: list[float]) -> F.Column:
    """The training time by which a source with this schedule has given the share of its tokens.

    ``schedule`` has the weights at evenly spaced times; between two of them the integral
    is quadratic, and its root is the position.
    """
    step = 1.0 / (len(schedule) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(schedule, schedule[1:], strict=False)]
    total, done = sum(areas), 0.0
    want, out = share * F.lit(total), F.lit(1.0)
    found = None
    for k, area in enumerate(areas):
        a, slope = schedule[k], (schedule[k + 1] - schedule[k]) / step
        rest = F.greatest(want - F.lit(done), F.lit(0.0))
        x = (F.sqrt(F.greatest(F.lit(a * a) + 2 * F.lit(slope) * rest, F.lit(0.0))) - F.lit(a)) / F.lit(slope) if slope else rest / F.lit(a) if a else F.lit(0.0)
        at = F.least(F.lit(k * step) + x, F.lit((k + 1) * step))
        done += area
        test = want <= F.lit(done)
        found = F.when(test, at) if found is None else found.when(test, at)
    return found.otherwise(out)


def curriculum(docs: DataFrame, most_repeats: int = 3, bucket_docs: int = 1000, schedules: list[list[float]] | None = None, seed: str = "mix") -> DataFrame:
    """What the mix takes of each document, and when.

    Returns doc_id, source, size, source_size, target, taken (words; a document's whole
    copies and a last part of one) and position (0 to 1). The schedules are dealt to the
    sources like their weights; the default lets weights be constant for the first,
    falling for the second and rising for the third.
    """
    schedules = schedules or [[1.0, 1.0], [1.5, 0.5], [0.5, 1.5]]
    sizes = materialize(word_sizes(docs).withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size")), "mix-sizes")
    buckets = partitions_for(sizes.count(), bucket_docs)
    keyed = sizes.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    parts = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    totals = parts.groupBy("source").agg(F.sum("part").alias("source_size"))
    targets = source_targets(totals, most_repeats).withColumn("style", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedules))
    bucket_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part").over(bucket_order), F.lit(0))).drop("part")
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "source_size", "target", "style")
    rows = keyed.alias("d").join(parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")))
    rows = rows.select("d.*", "before", "source_size", "target", "style")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.col("before") + F.sum("size").over(inside))
    words = lambda x: F.floor(F.col("target") * x / F.col("source_size")).cast("long")
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(words(F.col("upto")) - words(F.col("upto") - F.col("size")), F.col("size") * most_repeats))
    share = F.col("upto") / F.col("source_size")
    position = F.lit(1.0)
    for k, schedule in enumerate(schedules):
        position = F.when((F.col("style") == k) & (F.col("source_size") > 0), inverse_demand(share, schedule)).otherwise(position)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), position.alias("position"))


def range_sorted(mixed: DataFrame) -> DataFrame:
    """The documents in training order: range partitions by position, sorted within."""
    return mixed.orderBy("position", "doc_id")


@beside("doc_id", "text", "source", "n_chars")
def take(docs: DataFrame, most_repeats: int = 3) -> DataFrame:
    """The mix itself, with the columns of the documents: whole copies, then one cut to the words still wanted."""
    plan = curriculum(docs, most_repeats).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("same"), F.min("position").alias("position"))
    d = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    on = [d["doc_id"].eqNullSafe(plan["doc_id"]), d["source"].eqNullSafe(plan["source"]), d["size"].eqNullSafe(plan["size"])]
    # Repeated rows share their taken words; the first of them gets what can't be divided.
    rows = d.join(plan, on).select(d["*"], plan["taken"], plan["same"], plan["position"])
    mine = F.col("taken")
    many = Window.partitionBy("doc_id", "source", "size").orderBy("text")
    rows = rows.withColumn("k", F.when(F.col("same") > 1, F.row_number().over(many)).otherwise(F.lit(1)))
    mine = F.floor(mine * F.col("k") / F.col("same")) - F.floor(mine * (F.col("k") - 1) / F.col("same"))
    rows = rows.withColumn("mine", mine).where("mine > 0")
    rows = rows.withColumns({"whole": F.floor(F.col("mine") / F.col("size")), "part": F.col("mine") % F.col("size")})
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("whole").cast("int")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("cut", F.explode(copies))
    beginning = F.regexp_substr("text", F.concat(F.lit(r"(?s)^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("cut").cast("string"), F.lit("}+")))
    text = F.when(F.col("cut") == 0, F.col("text")).otherwise(beginning)
    rows = rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows.withColumn("text", text)
    return rows.select(*docs.columns, "position").orderBy("position", "doc_id").drop("position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_sorted(curriculum(read(spark, sf_dir, "documents"))).drop("source")
