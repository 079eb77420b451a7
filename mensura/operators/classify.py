"""Intermittency quadrants (Syntetos-Boylan) over a window that ends at a date or at every cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.operators.panel import month_number

ADI, CV2 = 1.32, 0.49
IDLE = "sin_actividad"


def classify_by_cut(facts: DataFrame, keys: list[str], cut_rows: DataFrame, window: int = 36) -> DataFrame:
    """keys, cut, quadrant, adi, cv2 of series with a row in the window; only rows up to the cut are used.

    The window begins at the series' first positive month if that is later. Periods are
    counted by the calendar, demands are positive months. adi and cv2 are NULL without demand.
    The deviation comes from sums, which whole units keep exact: at CV2 the class doesn't hang on the rows' order.
    """
    rows = facts.join(F.broadcast(cut_rows), F.col("month") <= F.col("cut"))
    positive = F.col("units") > 0
    inside = F.col("month") >= F.add_months("cut", 1 - window)
    y = F.when(positive & inside, F.col("units"))
    of = rows.groupBy(*keys, "cut").agg(F.min(F.when(positive, F.col("month"))).alias("first"), F.count_if(inside).alias("rows"), F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("s2")).where("rows > 0")
    begin = F.greatest(F.add_months("cut", 1 - window), F.coalesce("first", F.add_months("cut", 1 - window)))
    periods = month_number("cut") - month_number(begin) + 1
    spread = F.sqrt(F.greatest(F.col("n") * F.col("s2") - F.col("s") * F.col("s"), F.lit(0.0)))
    of = of.withColumn("adi", F.when(F.col("n") > 0, periods / F.col("n"))).withColumn("cv2", F.when(F.col("n") > 0, F.pow(spread / F.col("s"), 2)))
    steady, even = F.col("adi") < ADI, F.col("cv2") < CV2
    quadrant = F.when(F.col("n") == 0, IDLE).when(steady & even, "suave").when(steady, "erratica").when(even, "intermitente").otherwise("lumpy")
    return of.select(*keys, "cut", quadrant.alias("quadrant"), "adi", "cv2")


def classify(facts: DataFrame, keys: list[str], until: str, window: int = 36) -> DataFrame:
    one = facts.sparkSession.range(1).select(F.lit(until).cast("date").alias("cut"))
    return classify_by_cut(facts, keys, one, window).drop("cut")


def distribution(classes: DataFrame) -> DataFrame:
    """quadrant, n, percent, without series that have no demand."""
    from pyspark.sql import Window

    counts = classes.where(F.col("quadrant") != IDLE).groupBy("quadrant").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def stratified_sample(classes: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n series of each quadrant in an order by a seeded hash."""
    from pyspark.sql import Window

    order = Window.partitionBy("quadrant").orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), key)
    return classes.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")


def label(report: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    return report.join(classes.select(*keys, "quadrant"), keys, "left").withColumn("quadrant", F.coalesce("quadrant", F.lit(IDLE)))
