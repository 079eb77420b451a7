"""Model selection per series: retrospective, prospective by cut or quadrant, and the cascade by availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.operators.metrics import long, mase


def _position(models: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, models)), F.col("model"))


def best_overall(report: DataFrame, models: list[str], keys: list[str], fallback: str) -> DataFrame:
    """keys, model: least mean MASE over all cuts; the fallback where none can be scored."""
    means = mase(report, models, keys).groupBy(*keys, "model").agg(F.round(F.avg("mase") * (1 + 1e-10), 9).alias("m"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("m"), _position(models))
    top = means.withColumn("k", F.row_number().over(order)).where("k = 1")
    return top.select(*keys, F.when(F.col("m").isNull(), fallback).otherwise(F.col("model")).alias("model"))


def observed_mase(report: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """keys, cut, source, model, mase: of each earlier cut, by the horizons whose month the later cut can see.

    Errors are cumulated over horizons once; a later cut reads the sum at the last horizon it sees.
    """
    rows = long(report, models, [*keys, "cut", "horizon", "real", "scale"]).withColumnRenamed("cut", "source")
    w = Window.partitionBy(*keys, "source", "model").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    e = F.abs(F.col("real") - F.col("pred"))
    rows = rows.withColumns({"s": F.sum(e).over(w), "n": F.count(e).over(w)})
    cuts = report.select("cut").distinct()
    top = report.agg(F.max("horizon").alias("top"))
    pairs = cuts.select(F.col("cut").alias("source")).join(cuts, F.col("source") < F.col("cut")).crossJoin(F.broadcast(top))
    seen = F.least(F.months_between("cut", "source").cast("int"), F.col("top"))
    seen_rows = rows.join(F.broadcast(pairs.select("source", "cut", seen.alias("horizon"))), ["source", "horizon"])
    return seen_rows.select(*keys, "cut", "source", "model", F.round(F.try_divide(F.try_divide("s", "n"), F.nullif("scale", F.lit(0.0))), 9).alias("mase"))


def ranked(report: DataFrame, models: list[str], keys: list[str], fallback: str, quadrants: DataFrame | None = None) -> DataFrame:
    """keys, cut, model, rank (0 first), by what each cut can see; fixed order, the fallback first, without evidence.

    With ``quadrants`` (keys, cut, quadrant) the errors of all series of a quadrant as of
    the cut rank its models; series without one are a quadrant of their own.
    """
    seen = observed_mase(report, models, keys)
    universe = report.select(*keys, "cut").distinct()
    options = universe.crossJoin(report.sparkSession.createDataFrame([(m,) for m in models], "model string"))
    group = keys
    if quadrants is not None:
        group = ["quadrant"]
        of = lambda d: d.join(quadrants.select(*keys, "cut", "quadrant"), [*keys, "cut"], "left").withColumn("quadrant", F.coalesce("quadrant", F.lit("sin_actividad")))
        seen, options = of(seen), of(options)
    means = seen.groupBy(*group, "cut", "model").agg(F.round(F.avg("mase") * (1 + 1e-10), 9).alias("m"))
    rows = options.join(means, [*group, "cut", "model"], "left")
    per = Window.partitionBy(*keys, "cut")
    blind = F.count("m").over(per) == 0
    first = F.when(F.col("model") == fallback, 0).otherwise(1)
    rows = rows.withColumns({"blind": blind, "pos": _position(models), "lead": first})
    order = per.orderBy(F.when(F.col("blind"), F.col("lead")).otherwise(0), F.asc_nulls_last("m"), "pos")
    return rows.withColumn("rank", F.row_number().over(order) - 1).select(*keys, "cut", "model", "rank")


def cascade(report: DataFrame, ranking: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """Adds pred, used_model, used_rank: the best-ranked model that predicted the cell; all NULL if none did."""
    wide = ranking.groupBy(*keys, "cut").pivot("model", models).agg(F.first("rank")).select(*keys, "cut", *[F.col(m).alias(f"_r_{m}") for m in models])
    options = F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), F.struct(F.coalesce(f"_r_{m}", F.lit(len(models) + k)).alias("rank"), F.lit(m).alias("model"), F.col(m).alias("pred"))) for k, m in enumerate(models)]))
    rows = report.join(wide, [*keys, "cut"], "left").withColumn("_best", F.array_min(options))
    return rows.select(*report.columns, F.col("_best.pred").alias("pred"), F.col("_best.model").alias("used_model"), F.col("_best.rank").alias("used_rank"))


def selected(report: DataFrame, winners: DataFrame, models: list[str], keys: list[str], fallback: str) -> DataFrame:
    """Adds pred of each series' winner; a winner that is none of the models is an error."""
    rows = report.join(winners.select(*keys, F.col("model").alias("winner")), keys, "left").withColumn("winner", F.coalesce("winner", F.lit(fallback)))
    pred = F.coalesce(*[F.when(F.col("winner") == m, F.col(m)) for m in models])
    known = F.col("winner").isin(*models)
    return rows.withColumn("pred", F.when(known, pred).otherwise(F.raise_error(F.concat(F.lit("unknown winner "), "winner")).cast("double")))


def provenance(cascaded: DataFrame) -> DataFrame:
    origin = F.when(F.col("used_rank").isNull(), "nobody").when(F.col("used_rank") == 0, "winner").otherwise("cascade")
    counts = cascaded.groupBy(origin.alias("origin")).agg(F.count("*").alias("rows"))
    return counts.withColumn("percent", F.round(100 * F.col("rows") / F.sum("rows").over(Window.partitionBy()), 2))


def stability(ranking: DataFrame, keys: list[str]) -> DataFrame:
    """changes, series, percent: how often series change their winner from cut to cut."""
    w = Window.partitionBy(*keys).orderBy("cut")
    moved = ranking.where("rank = 0").withColumn("moved", (F.col("model") != F.lag("model").over(w)).cast("long"))
    counts = moved.groupBy(*keys).agg(F.coalesce(F.sum("moved"), F.lit(0)).alias("changes")).groupBy("changes").agg(F.count("*").alias("series"))
    return counts.withColumn("percent", F.round(100 * F.col("series") / F.sum("series").over(Window.partitionBy()), 1))


def winners(ranking: DataFrame, classes: DataFrame | None, keys: list[str], names: list[str]) -> DataFrame:
    """model, a column for each quadrant, total: how many series and cuts each model won."""
    top = ranking.where("rank = 0")
    if classes is None:
        return top.groupBy("model").agg(F.count("*").alias("total"))
    top = top.join(classes.select(*keys, "quadrant"), keys, "left").withColumn("quadrant", F.coalesce("quadrant", F.lit("sin_clasificar")))
    wide = top.groupBy("model").pivot("quadrant", names).agg(F.count("model"))
    return wide.join(top.groupBy("model").agg(F.count("*").alias("total")), "model").na.fill(0)


def quadrant_winners(ranking: DataFrame, quadrants: DataFrame, keys: list[str]) -> DataFrame:
    """cut, quadrant, model: the one winner of each; more than one is an error."""
    top = ranking.where("rank = 0").join(quadrants, [*keys, "cut"]).groupBy("cut", "quadrant").agg(F.min("model").alias("model"), F.countDistinct("model").alias("n"))
    return top.withColumn("model", F.when(F.col("n") > 1, F.raise_error(F.lit("more than one winner"))).otherwise(F.col("model"))).drop("n")
