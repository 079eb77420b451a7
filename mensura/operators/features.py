"""Features as of a cut: price against its level, lags, rolling statistics, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.operators import deflate

LAGS, WINDOWS = (1, 2, 3, 6, 12), (3, 6, 12)


def relative_price(facts: DataFrame, catalog: DataFrame, index: DataFrame, cut: str) -> DataFrame:
    """product_id, month, price_rel_level and its change over 3 and 12 calendar months; contrast levels only."""
    day = F.lit(cut).cast("date")
    rows = facts.where(F.col("month") <= day).select("product_id", "month", "avg_price")
    rows = deflate.with_factor(rows, index, catalog, "month", day, deflate.CASCADE[:2]).join(deflate.anchors(facts, catalog, index, cut).drop("origin"), "product_id", "left")
    value = F.when(deflate.usable(F.col("avg_price")) & (F.col("anchor") > 0), F.col("avg_price") * F.col("factor") / F.col("anchor"))
    rows = rows.select("product_id", "month", "anchor", value.alias("price_rel_level"))
    for n in (3, 12):
        past = rows.select("product_id", F.add_months("month", n).alias("month"), F.col("price_rel_level").alias("past"))
        rows = rows.join(past, ["product_id", "month"], "left").withColumn(f"var_price_rel_{n}m", F.try_divide("price_rel_level", "past") - 1).drop("past")
    return rows


def build(facts: DataFrame, catalog: DataFrame, index: DataFrame, cut: str) -> DataFrame:
    """One row a visible fact, with a stable schema."""
    rows = relative_price(facts, catalog, index, cut).withColumnRenamed("anchor", "price_anchor")
    one = catalog.dropDuplicates(["product_id"]).select("product_id", "category", "lab")
    return rows.join(one, "product_id", "left").select("product_id", "month", "price_anchor", "price_rel_level", "var_price_rel_3m", "var_price_rel_12m", "category", "lab")


def lags(panel: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("month")
    return panel.select(*keys, "month", *[F.lag("units", k).over(w).alias(f"lag_{k}") for k in LAGS], F.month("month").alias("month_of_year"))


def rolling(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, deviation and their quotient of the 3, 6 and 12 months before; NULL unless the window is full."""
    w = Window.partitionBy(*keys).orderBy("month")
    out = []
    for k in WINDOWS:
        f = w.rowsBetween(-k, -1)
        full = F.count("units").over(f) == k
        mean, sd = F.when(full, F.avg("units").over(f)), F.when(full, F.stddev_samp("units").over(f))
        out += [mean.alias(f"mean_{k}"), sd.alias(f"sd_{k}"), F.when(F.abs(mean) > 1e-9, sd / mean).alias(f"cv_{k}")]
    return panel.select(*keys, "month", *out)


def coverage(features: DataFrame) -> DataFrame:
    """column, filled, share."""
    names = [c for c in features.columns if c not in ("product_id", "month")]
    one = features.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in names])
    return one.unpivot(["_n"], names, "column", "filled").select("column", "filled", F.round(F.try_divide(F.col("filled"), F.col("_n")), 6).alias("share"))


def series_length(panel: DataFrame, keys: list[str]) -> DataFrame:
    """How many series there are and the share long enough for the longest lag."""
    n = panel.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("series"), F.round(F.avg((F.col("n") >= max(LAGS) + 1).cast("double")), 6).alias("share_long"), F.max("n").alias("longest"))
