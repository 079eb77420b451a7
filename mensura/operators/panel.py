"""Dense monthly panels, cuts and backtests of models that need one pass for all cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense(facts: DataFrame, keys: list[str], until: str | None, zero: str = "units") -> DataFrame:
    """Every month of every series from its first row, whatever its sign, to ``until``; only ``zero`` is filled with 0."""
    end = F.lit(until).cast("date") if until else F.lit(facts.agg(F.max("month")).first()[0])
    facts = facts.where(F.col("month") <= end)
    grid = facts.groupBy(*keys).agg(F.min("month").alias("first")).withColumn("month", F.explode(F.sequence("first", end, F.expr("interval 1 month")))).drop("first")
    return grid.join(facts, [*keys, "month"], "left").withColumn(zero, F.coalesce(zero, F.lit(0.0)))


def cuts(facts: DataFrame, until: str | None, n: int = 18) -> DataFrame:
    """The last n calendar months before the final one."""
    end = F.lit(until).cast("date") if until else F.max("month")
    span = facts.agg(F.min("month").alias("lo"), end.alias("hi"))
    months = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("cut"), "hi").where("cut < hi").drop("hi")
    found = months.orderBy(F.desc("cut")).limit(n)
    if found.count() < n:
        raise ValueError(f"the data have fewer than {n + 1} months")
    return found


def trimmed(table: DataFrame, cut: str, column: str = "computed_on") -> DataFrame:
    """An auxiliary table as a cut may see it; one without the date column is whole at every cut."""
    return table.where(F.col(column) <= F.lit(cut).cast("date")) if column in table.columns else table


def month_number(column: Column | str) -> Column:
    return F.year(column) * 12 + F.month(column)


def states(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Per series and month what the simple models know then: last, mean of 3, the last 12 months, running seasonal scale.

    A model's state at a month depends on nothing later, so one pass serves every cut.
    """
    w = Window.partitionBy(*keys).orderBy("month")
    last3 = w.rowsBetween(-2, 0)
    mean3 = F.when(F.count("units").over(last3) == 3, F.avg("units").over(last3))
    out = panel.select(*keys, "month", "units").withColumns({"mean3": mean3, "year": F.collect_list("units").over(w.rowsBetween(-11, 0)), "d12": F.abs(F.col("units") - F.lag("units", 12).over(w))})
    return out.withColumn("scale", F.avg("d12").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("d12")


def backtest(panel: DataFrame, cut_rows: DataFrame, keys: list[str], horizon: int = 12) -> DataFrame:
    """Report: keys, cut, horizon, month, real, and a column for each model; NULL where it can't predict."""
    at_cut = states(panel, keys).join(F.broadcast(cut_rows), F.col("month") == F.col("cut")).drop("month")
    if "croston" in panel.columns:
        at_cut = at_cut.join(panel.select(*keys, F.col("month").alias("cut"), "croston", "tsb"), [*keys, "cut"])
    steps = at_cut.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("month", F.add_months("cut", F.col("horizon")))
    # The same month a year or more before; short series cover as many months as they have.
    back = F.size("year") - 12 + ((F.col("horizon") - 1) % 12)
    seasonal = F.when(back >= 0, F.get("year", back))
    actual = panel.select(*keys, "month", F.col("units").alias("real"))
    models = [seasonal.alias("SeasonalNaive"), F.col("mean3").alias("WindowAverage"), F.col("units").alias("LastValue")]
    models += [F.col("croston").alias("CrostonSBA"), F.col("tsb").alias("TSB")] if "croston" in panel.columns else []
    return steps.join(actual, [*keys, "month"]).select(*keys, "cut", "horizon", "month", "real", *models, "scale")


def intermittent_states(panel: DataFrame, keys: list[str], alpha: float = 0.1, alpha_tsb: float = 0.2) -> DataFrame:
    """Croston-SBA and TSB forecasts as of every month, by one fold over each series' ordered months."""
    series = panel.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("month", "units"))).alias("ys"))
    start = F.struct(F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("p"), F.lit(0).alias("gap"), F.lit(None).cast("double").alias("tz"), F.lit(None).cast("double").alias("tp"), F.array().cast("array<struct<month:date,units:double,croston:double,tsb:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        hit, y = x["units"] > 0, x["units"]
        gap = (a["gap"] + 1).cast("double")
        smooth = lambda old, new, k: F.when(old.isNull(), new).otherwise(F.lit(k) * new + F.lit(1 - k) * old)
        z, p = F.when(hit, smooth(a["z"], y, alpha)).otherwise(a["z"]), F.when(hit, smooth(a["p"], gap, alpha)).otherwise(a["p"])
        tz, tp = F.when(hit, smooth(a["tz"], y, alpha_tsb)).otherwise(a["tz"]), smooth(a["tp"], hit.cast("double"), alpha_tsb)
        row = F.struct(x["month"].alias("month"), y.alias("units"), F.coalesce(F.lit(1 - alpha / 2) * z / p, F.lit(0.0)).alias("croston"), F.coalesce(tp * tz, F.lit(0.0)).alias("tsb"))
        return F.struct(z.alias("z"), p.alias("p"), F.when(hit, 0).otherwise(a["gap"] + 1).alias("gap"), tz.alias("tz"), tp.alias("tp"), F.array_append(a["out"], row).alias("out"))

    return series.select(*keys, F.inline(F.aggregate("ys", start, step)["out"]))
