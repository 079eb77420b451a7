"""Implicit price indices, anchors and deflators with a cascade of levels, as of a cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.operators.panel import month_number

CASCADE = ("category", "lab", "ipc")
CLAMP, CAP, LEAST_PAIRS = 3.0, 10.0, 3


def usable(price: Column) -> Column:
    return price.isNotNull() & ~F.isnan(price) & (price > 0) & (price < F.lit(float("inf")))


def relatives(facts: DataFrame) -> DataFrame:
    """product_id, month, relative, weight: a usable price over the last month's; the mean of both revenues weighs it."""
    w = Window.partitionBy("product_id").orderBy("month")
    rows = facts.where(usable(F.col("avg_price")))
    rows = rows.withColumns({"p0": F.lag("avg_price").over(w), "r0": F.lag("revenue").over(w), "m0": F.lag("month").over(w)})
    rows = rows.where(month_number("month") - month_number("m0") == 1)
    return rows.select("product_id", "month", (F.col("avg_price") / F.col("p0")).alias("relative"), ((F.col("revenue") + F.col("r0")) / 2).alias("weight"))


def clamped(column: Column, limit: float = CLAMP) -> Column:
    if limit <= 1:
        raise ValueError("a limit of relatives is more than 1")
    return F.least(F.greatest(column, F.lit(1 / limit)), F.lit(limit))


def level_index(rel: DataFrame, catalog: DataFrame, level: str) -> DataFrame:
    """level, level_id, month, index: weighted geometric means of clamped relatives, chained, 1 at the first month.

    Months with fewer than three pairs are skipped; a group with a bad weight is averaged evenly.
    """
    rows = rel.join(catalog.select("product_id", F.col(level).alias("level_id")), "product_id").where("level_id is not null")
    ln = F.ln(clamped(F.col("relative")))
    even = (F.min("weight") <= 0) | (F.max("weight") >= F.lit(float("inf"))) | (F.count("weight") < F.count("*"))
    month = rows.groupBy("level_id", "month").agg(F.count("*").alias("n"), F.when(even, F.avg(ln)).otherwise(F.try_divide(F.sum(F.col("weight") * ln), F.sum("weight"))).alias("g")).where(F.col("n") >= LEAST_PAIRS)
    w = Window.partitionBy("level_id").orderBy("month")
    index = F.exp(F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.first("g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return month.select(F.lit(level).alias("level"), "level_id", "month", index.alias("index"))


def factor_between(index: DataFrame, start: str, end: str) -> DataFrame:
    """level, level_id, factor: the index at ``end`` over that at ``start``; NULL where a month is missing or the base isn't positive."""
    at = lambda month: F.max(F.when(F.col("month") == F.lit(month).cast("date"), F.col("index")))
    both = index.groupBy("level", "level_id").agg(at(start).alias("a"), at(end).alias("b"))
    return both.select("level", "level_id", F.when(F.col("a") > 0, F.col("b") / F.col("a")).alias("factor"))


def indices(facts: DataFrame, catalog: DataFrame | None, cpi: DataFrame) -> DataFrame:
    national = cpi.select(F.lit("ipc").alias("level"), F.lit("nacional").alias("level_id"), "month", F.col("index").cast("double").alias("index"))
    if catalog is None:
        return national
    rel = relatives(facts)
    return level_index(rel, catalog, "category").union(level_index(rel, catalog, "lab")).union(national)


def own_anchor(facts: DataFrame, cut: str, months: int = 3) -> DataFrame:
    """product_id, anchor: unit-weighted price of the last three months, or their plain mean without positive units."""
    day = F.lit(cut).cast("date")
    rows = facts.where((F.col("month") <= day) & (F.col("month") > F.add_months(day, -months)) & usable(F.col("avg_price")))
    pos = F.col("units") > 0
    weighted = F.try_divide(F.sum(F.when(pos, F.col("avg_price") * F.col("units"))), F.sum(F.when(pos, F.col("units"))))
    return rows.groupBy("product_id").agg(F.coalesce(weighted, F.avg("avg_price")).alias("anchor"))


def last_price(facts: DataFrame, cut: str) -> DataFrame:
    rows = facts.where((F.col("month") <= F.lit(cut).cast("date")) & usable(F.col("avg_price")))
    return rows.groupBy("product_id").agg(F.max_by("avg_price", "month").alias("price"), F.max("month").alias("price_month"))


def with_factor(rows: DataFrame, index: DataFrame, catalog: DataFrame, since: str, until: Column, levels: tuple[str, ...] = CASCADE, suffix: str = "") -> DataFrame:
    """Adds factor and rung: I(until)/I(since) of the first level that has both months and a positive base."""
    rows = rows.join(catalog.select("product_id", F.col("category").alias("_category"), F.col("lab").alias("_lab")), "product_id", "left").withColumns({"_ipc": F.lit("nacional"), "_until": until})
    options = []
    for level in levels:
        part = index.where(F.col("level") == level)
        for side, month in (("a", since), ("b", "_until")):
            at = part.select(F.col("level_id").alias(f"_{level}"), F.col("month").alias(month), F.col("index").alias(f"_{side}_{level}"))
            rows = rows.join(F.broadcast(at) if level == "ipc" else at, [f"_{level}", month], "left")
        options.append((level, F.when(F.col(f"_a_{level}") > 0, F.col(f"_b_{level}") / F.col(f"_a_{level}"))))
    factor = F.coalesce(*[o for _, o in options])
    rung = F.coalesce(*[F.when(o.isNotNull(), F.lit(level)) for level, o in options])
    rows = rows.withColumns({f"factor{suffix}": factor, f"rung{suffix}": rung})
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def anchors(facts: DataFrame, catalog: DataFrame, index: DataFrame, cut: str) -> DataFrame:
    """product_id, anchor, origin: own, or the last usable price carried to the cut by the cascade, or none."""
    products = facts.where(F.col("month") <= F.lit(cut).cast("date")).select("product_id").distinct()
    carried = with_factor(last_price(facts, cut), index, catalog, "price_month", F.lit(cut).cast("date"))
    rows = products.join(own_anchor(facts, cut), "product_id", "left").join(carried, "product_id", "left")
    value = F.coalesce("anchor", F.col("price") * F.col("factor"))
    origin = F.when(F.col("anchor").isNotNull(), "producto").when(F.col("factor").isNotNull() & F.col("price").isNotNull(), F.col("rung")).otherwise("sin_ancla")
    return rows.select("product_id", value.alias("anchor"), origin.alias("origin"))


def deflators(facts: DataFrame, catalog: DataFrame, index: DataFrame, cut: str) -> DataFrame:
    """product_id, month, deflator of rows up to the cut of products with a usable price.

    The nearest own price (last before, else first after, inside the cut) is moved to the
    row's month by the cascade; the quotient to the level's own deflator is capped at 10
    either way, never against the consumer index.
    """
    day = F.lit(cut).cast("date")
    rows = facts.where(F.col("month") <= day)
    good = usable(F.col("avg_price"))
    back = Window.partitionBy("product_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("product_id").orderBy("month").rowsBetween(0, Window.unboundedFollowing)
    near = lambda c: F.coalesce(F.last(F.when(good, c), True).over(back), F.first(F.when(good, c), True).over(ahead))
    rows = rows.select("product_id", "month", near(F.col("avg_price")).alias("price"), near(F.col("month")).alias("price_month")).where("price is not null")
    rows = with_factor(rows, index, catalog, "price_month", F.col("month"))
    factor = F.when(F.col("price_month") == F.col("month"), F.lit(1.0)).otherwise(F.col("factor"))
    rows = rows.withColumn("factor", factor).join(anchors(facts, catalog, index, cut).drop("origin"), "product_id")
    rows = rows.withColumn("raw", F.col("anchor") / (F.col("price") * F.col("factor")))
    rows = with_factor(rows.drop("factor", "rung"), index, catalog, "month", day, CASCADE[:2], "_level")
    q = F.col("raw") / F.col("factor_level")
    capped = F.least(F.greatest(q, F.lit(1 / CAP)), F.lit(CAP)) * F.col("factor_level")
    return rows.select("product_id", "month", F.coalesce(F.when(F.col("factor_level") > 0, capped), F.col("raw")).alias("deflator"))


def deflated(rows: DataFrame, deflator: DataFrame, column: str = "revenue") -> DataFrame:
    """Adds <column>_real; rows without a deflator keep NULL. Works at any grain with product and month."""
    return rows.join(deflator, ["product_id", "month"], "left").withColumn(f"{column}_real", F.col(column) * F.col("deflator"))
