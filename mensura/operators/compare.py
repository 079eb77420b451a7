"""Contenders against each other, and how improvements spread over series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.operators.metrics import by_level, long, scores


def wape_by_series(report: DataFrame, models: list[str], keys: list[str]) -> DataFrame:
    return scores(long(report, models, [*keys, "horizon", "real"]), ["model", *keys, "horizon"])


def improvement(report: DataFrame, champion: str, challenger: str, keys: list[str], by: list[str]) -> DataFrame:
    """Per group: series, those not comparable, wins and quartiles of the champion's WAPE less the challenger's.

    Comparable means that both cover the series, and equally; a horizon that a series lacks is not comparable.
    """
    one = wape_by_series(report, [champion, challenger], keys)
    wide = one.groupBy(*keys, "horizon").agg(*[F.max(F.when(F.col("model") == m, F.col(v))).alias(f"{v}_{k}") for k, m in (("a", champion), ("b", challenger)) for v in ("wape", "coverage")])
    grid = wide.select(*keys).distinct().crossJoin(F.broadcast(wide.select("horizon").distinct()))
    wide = grid.join(wide, [*keys, "horizon"], "left")
    if by != ["horizon"]:
        wide = wide.join(report.select(*keys, *[b for b in by if b != "horizon"]).distinct(), keys)
    fair = F.coalesce((F.col("coverage_a") > 0) & (F.col("coverage_a") == F.col("coverage_b")), F.lit(False))
    gain = F.when(fair, F.col("wape_a") - F.col("wape_b"))
    rows = wide.withColumn("gain", gain)
    q = lambda p: F.round(F.percentile("gain", F.lit(p)) * (1 + 1e-10), 6)
    return rows.groupBy(*by).agg(F.count("*").alias("series"), F.count_if(F.col("gain").isNull()).alias("not_comparable"), F.count_if(F.col("gain") > 0).alias("wins"), F.round(F.try_divide(100.0 * F.count_if(F.col("gain") > 0), F.count("gain")), 1).alias("percent_wins"), q(0.5).alias("median"), q(0.25).alias("p25"), q(0.75).alias("p75"))


def head_to_head(report: DataFrame, contenders: list[str], levels: dict[str, list[str]], extra: list[str]) -> DataFrame:
    return by_level(report, contenders, levels, extra).withColumnRenamed("model", "contender")


def head_to_head_by(report: DataFrame, contenders: list[str], group: str) -> DataFrame:
    """Row grain by group and horizon, with the group's share of all actuals at the horizon."""
    out = scores(long(report, contenders, [group, "horizon", "real"]), ["model", group, "horizon"]).withColumnRenamed("model", "contender")
    weight = report.groupBy(group, "horizon").agg(F.sum(F.abs("real")).alias("x")).withColumn("weight", F.round(100 * F.col("x") / F.sum("x").over(Window.partitionBy("horizon")), 4)).drop("x")
    return out.join(weight, [group, "horizon"])
