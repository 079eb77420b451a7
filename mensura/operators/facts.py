"""Monthly facts from sale lines, and checks of their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GIFT_PRICE = 0.05


def without_gifts(lines: DataFrame) -> DataFrame:
    """Lines priced above the give-away threshold; a null price is a gift."""
    return lines.where(F.coalesce("price", F.lit(0.0)) > GIFT_PRICE)


def netted(lines: DataFrame, *keys: str) -> DataFrame:
    """Units and revenue by key and month, credit notes subtracted; months that net to zero stay."""
    sign = F.when(F.col("credit_note"), -1.0).otherwise(1.0)
    return lines.groupBy(*keys, "month").agg(F.sum(sign * F.col("quantity")).alias("units"), F.sum(sign * F.col("amount")).alias("revenue"))


def with_price(facts: DataFrame) -> DataFrame:
    return facts.withColumn("avg_price", F.try_divide("revenue", F.nullif("units", F.lit(0.0))))


def product_facts(lines: DataFrame) -> DataFrame:
    return with_price(netted(lines, "product_id"))


def rollup(client_facts: DataFrame) -> DataFrame:
    """Client-product months summed to product months."""
    return with_price(client_facts.groupBy("product_id", "month").agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue")))


def active_products(facts: DataFrame, until: str, months: int = 12) -> DataFrame:
    """Facts of products with a positive month among the last ``months``; 0 keeps all."""
    if months <= 0:
        return facts
    recent = facts.where((F.col("units") > 0) & (F.col("month") <= F.lit(until).cast("date")) & (F.col("month") > F.add_months(F.lit(until).cast("date"), -months)))
    return facts.join(recent.select("product_id").distinct(), "product_id", "left_semi")


def incomplete_months(facts: DataFrame, least: float = 0.5, window: int = 12, least_months: int = 6) -> DataFrame:
    """month, units, ratio of the months at the end that are all under ``least`` times the median of those before."""
    by_month = facts.groupBy("month").agg(F.sum("units").alias("units"))
    back = Window.orderBy("month").rowsBetween(-window, -1)
    median = F.when(F.count("units").over(back) >= least_months, F.percentile("units", F.lit(0.5)).over(back))
    rated = by_month.withColumn("ratio", F.try_divide("units", median)).withColumn("low", F.coalesce(F.col("ratio") < least, F.lit(False)).cast("int"))
    tail = Window.orderBy("month").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rated.withColumn("all_low", F.min("low").over(tail)).where("all_low = 1").select("month", "units", "ratio")


def extract_checks(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """check, value: counts that tell whether an extract can be used."""
    one = facts.agg(F.count("*").alias("rows"), F.countDistinct("product_id").alias("products"), F.countDistinct("month").alias("months"), F.count_if(F.col("units") < 0).alias("negative_units"), F.count_if(F.col("units") == 0).alias("zero_units"), F.count_if(F.col("avg_price").isNull()).alias("null_price"), (F.months_between(F.max("month"), F.min("month")) + 1 - F.countDistinct("month")).cast("long").alias("missing_months"))
    more = catalog.agg(F.countDistinct("category").alias("categories"))
    return one.crossJoin(more).unpivot([], [*one.columns, "categories"], "check", "value")


def first_products(facts: DataFrame, n: int) -> DataFrame:
    """The n least product ids, for small frozen samples."""
    return facts.select("product_id").distinct().orderBy("product_id").limit(n)


def differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Keys where two tables of one grain differ, by value or because one lacks the row."""
    both = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(True).alias("in_a")).join(b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(True).alias("in_b")), keys, "full")
    same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    for v in values:
        same &= F.coalesce(F.abs(F.col(f"{v}_a") - F.col(f"{v}_b")) <= tolerance, F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b")))
    return both.where(~same).drop("in_a", "in_b")


def category_shares(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """category, products, percent of all products that sell."""
    sold = facts.select("product_id").distinct().join(catalog.select("product_id", "category"), "product_id", "left")
    counts = sold.groupBy("category").agg(F.count("*").alias("products"))
    total = counts.agg(F.sum("products").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", "products", F.round(100 * F.col("products") / F.col("total"), 4).alias("percent"))


def without_recent_sale(facts: DataFrame, until: str, months: int) -> DataFrame:
    """products, stale, percent: those with no units above 0 in the last ``months`` months."""
    recent = F.col("month") > F.add_months(F.lit(until).cast("date"), -months)
    one = facts.where(F.col("month") <= F.lit(until).cast("date")).groupBy("product_id").agg(F.max(F.when(recent & (F.col("units") > 0), 1).otherwise(0)).alias("sold"))
    return one.agg(F.count("*").alias("products"), F.count_if(F.col("sold") == 0).alias("stale")).withColumn("percent", F.round(F.try_divide(100 * F.col("stale"), F.col("products")), 4))


def fingerprint(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count("*").alias("rows"), F.countDistinct("product_id").alias("series"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.round(F.sum("units"), 2).alias("total"))


def births_and_deaths(facts: DataFrame, until: str, silence: int = 25) -> DataFrame:
    """Products born and dead by year: dead means silent for so long at the end, and longer than ever before."""
    sold = facts.where("units > 0").select("product_id", "month")
    number = F.year("month") * 12 + F.month("month")
    gap = number - F.lag(number).over(Window.partitionBy("product_id").orderBy("month"))
    life = sold.withColumn("gap", gap).groupBy("product_id").agg(F.min("month").alias("born"), F.max("month").alias("last"), F.coalesce(F.max("gap"), F.lit(0)).alias("gap"))
    end = F.lit(until).cast("date")
    quiet = (F.year(end) * 12 + F.month(end)) - (F.year("last") * 12 + F.month("last"))
    life = life.withColumn("dead", (quiet >= silence) & (quiet > F.col("gap")))
    return life.groupBy(F.year("born").alias("year")).agg(F.count("*").alias("births"), F.count_if("dead").alias("deaths"))


def purchase_histogram(client_facts: DataFrame) -> DataFrame:
    months = client_facts.where("units > 0").groupBy("client_id", "product_id").agg(F.countDistinct("month").alias("m"))
    label = F.when(F.col("m") <= 2, "1-2").when(F.col("m") <= 5, "3-5").when(F.col("m") <= 11, "6-11").when(F.col("m") <= 23, "12-23").otherwise("24+")
    return months.groupBy(label.alias("months")).agg(F.count("*").alias("pairs"))


def client_features(client_facts: DataFrame, lines: DataFrame, catalog: DataFrame, at: str) -> DataFrame:
    """One row a client, from what was known on the day ``at``."""
    day = F.lit(at).cast("date")
    month = F.trunc(day, "MM")
    known = client_facts.where(F.col("month") <= month)
    year = known.where(F.col("month") > F.add_months(month, -12))
    late, early = F.col("month") > F.add_months(month, -3), (F.col("month") > F.add_months(month, -6)) & (F.col("month") <= F.add_months(month, -3))
    sums = year.groupBy("client_id").agg(F.sum("units").alias("annual_units"), F.sum("revenue").alias("annual_value"), F.sum(F.when(late, F.col("units")).otherwise(0.0)).alias("u1"), F.sum(F.when(early, F.col("units")).otherwise(0.0)).alias("u0"))
    by_category = year.join(catalog, "product_id").groupBy("client_id", "category").agg(F.sum("units").alias("u"))
    main = by_category.groupBy("client_id").agg(F.max_by("category", F.struct("u", "category")).alias("main_category"))
    last = lines.where((F.col("date") <= day) & ~F.col("credit_note")).groupBy("client_id").agg(F.max("date").alias("last"), F.countDistinct("month").alias("active"))
    label = F.when(F.col("active") <= 3, "ocasional").when(F.col("active") <= 9, "regular").otherwise("frecuente")
    trend = F.when(F.col("u0") > 0, F.col("u1") / F.col("u0") - 1).otherwise(0.0)
    return sums.join(main, "client_id").join(last, "client_id").select("client_id", "main_category", label.alias("frequency"), "annual_units", "annual_value", trend.alias("trend_3m"), F.datediff(day, "last").cast("long").alias("recency_days"), day.alias("computed_on"))
