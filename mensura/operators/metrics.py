"""Error metrics of reports with a column for each model; coverage and row counts always go along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (1, 3, 6, 12)


def wape(real: Column, pred: Column) -> Column:
    """A missing prediction adds no error but its actual stays below the line; NULL without actuals."""
    return F.try_divide(F.coalesce(F.sum(F.abs(real - pred)), F.lit(0.0)), F.nullif(F.sum(F.abs(real)), F.lit(0.0)))


def bias(real: Column, pred: Column) -> Column:
    return F.try_divide(F.coalesce(F.sum(pred - real), F.lit(0.0)), F.nullif(F.sum(F.abs(real)), F.lit(0.0)))


def long(report: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    """One row a model and cell, in one pass."""
    return report.select(*keep, *[F.col(m).cast("double").alias(m) for m in models]).unpivot(keep, models, "model", "pred")


def scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """wape, bias, n, coverage of (real, pred) rows by group; a null group key is an error in the data and raises."""
    for c in by:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null {c}")).cast(rows.schema[c].dataType)).otherwise(F.col(c)))
    r, p = F.col("real"), F.col("pred")
    return rows.groupBy(*by).agg(F.round(wape(r, p), 6).alias("wape"), F.round(bias(r, p), 6).alias("bias"), F.count("*").alias("n"), F.round(F.avg(p.isNotNull().cast("double")), 6).alias("coverage"))


def level_sums(rows: DataFrame, level: list[str], by: list[str]) -> DataFrame:
    """Actuals and predictions summed to a level before measuring; a cell without any prediction stays NULL."""
    return rows.groupBy(*dict.fromkeys([*level, *by, "month", "cut"])).agg(F.sum("real").alias("real"), F.sum("pred").alias("pred"))


def by_level(report: DataFrame, models: list[str], levels: dict[str, list[str]], extra: list[str]) -> DataFrame:
    """level, model, horizon with scores; each level sums first, so errors may cancel."""
    keep = list(dict.fromkeys([*extra, "month", "cut", "horizon", "real"]))
    rows = long(report.where(F.col("horizon").isin(*HORIZONS)), models, keep)
    parts = [scores(level_sums(rows, columns, ["model", "horizon"]), ["model", "horizon"]).withColumn("level", F.lit(name)) for name, columns in levels.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("level", "model", "horizon", "wape", "bias", "n", "coverage")


def worst(rows: DataFrame, by: list[str], score: str, keys: list[str]) -> DataFrame:
    """Per group the row with the largest score, the least keys first among equals."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), *keys)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*by, *keys, score)


def mase(report: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    """keys, cut, model, mase: mean error over the seasonal-naive error of the dense history up to the cut."""
    rows = long(report, models, [*keys, "cut", "real", "scale"])
    error = F.avg(F.abs(F.col("real") - F.col("pred")))
    return rows.groupBy(*keys, "cut", "model").agg(F.round(F.try_divide(error, F.nullif(F.max("scale"), F.lit(0.0))), 9).alias("mase"))


def mase_by_horizon(report: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    cells = long(report.where(F.col("horizon").isin(*HORIZONS)), models, [*keys, "cut", "horizon"]).select(*keys, "cut", "horizon", "model")
    rows = cells.join(mase(report, models, keys), [*keys, "cut", "model"])
    return rows.groupBy("model", "horizon").agg(F.round(F.avg("mase"), 6).alias("mean_mase"), F.round(F.percentile("mase", F.lit(0.5)), 6).alias("median_mase"), F.count("*").alias("n"))


def interval_coverage(report: DataFrame, lo: str, hi: str, by: list[str], nominal: float = 0.8) -> DataFrame:
    """Empirical coverage of closed intervals, its deviation and the relative width; rows without one count nowhere."""
    has = F.col(lo).isNotNull() & F.col(hi).isNotNull()
    inside = F.when(has, ((F.col("real") >= F.col(lo)) & (F.col("real") <= F.col(hi))).cast("double"))
    rows = report.groupBy(*by).agg(F.avg(inside).alias("c"), F.try_divide(F.sum(F.when(has, F.col(hi) - F.col(lo))), F.nullif(F.sum(F.when(has, F.abs("real"))), F.lit(0.0))).alias("w"), F.count_if(has).alias("n"))
    return rows.select(*by, F.round("c", 6).alias("coverage"), F.round(F.col("c") - nominal, 6).alias("deviation"), F.round("w", 6).alias("relative_width"), "n")


def pinball(report: DataFrame, quantiles: dict[str, float], by: list[str]) -> DataFrame:
    rows = report.unpivot([*by, "real"], list(quantiles), "quantile", "pred").where("pred is not null")
    q = F.coalesce(*[F.when(F.col("quantile") == k, F.lit(v)) for k, v in quantiles.items()])
    e = F.col("real") - F.col("pred")
    return rows.groupBy(*by, "quantile").agg(F.round(F.try_divide(F.sum(F.greatest(q * e, (q - 1) * e)), F.nullif(F.sum(F.abs("real")), F.lit(0.0))), 6).alias("pinball"), F.count("*").alias("n"))


def crossing_rate(report: DataFrame, ordered: list[str], by: list[str]) -> DataFrame:
    all_there, crossed = F.lit(True), F.lit(False)
    for c in ordered:
        all_there = all_there & F.col(c).isNotNull()
    for a, b in zip(ordered, ordered[1:], strict=False):
        crossed = crossed | (F.col(b) < F.col(a))
    return report.groupBy(*by).agg(F.round(F.avg(F.when(all_there, crossed.cast("double"))), 6).alias("crossing_rate"), F.count_if(all_there).alias("n"))


def empirical_intervals(report: DataFrame, model: str, by: list[str], levels: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """P10, P50, P90 of each cell: the model's prediction plus quantiles of its earlier errors that were visible at the cut."""
    errors = report.where(F.col(model).isNotNull()).select(*by, "month", (F.col("real") - F.col(model)).alias("e"))
    cut_rows = report.select("cut").distinct()
    seen = errors.join(F.broadcast(cut_rows), F.col("month") <= F.col("cut")).groupBy(*by, "cut").agg(*[F.percentile("e", F.lit(q)).alias(f"q{int(q * 100)}") for q in levels])
    rows = report.join(seen, [*by, "cut"], "left")
    return rows.select(*report.columns, *[(F.col(model) + F.col(f"q{int(q * 100)}")).alias(f"P{int(q * 100)}") for q in levels])
