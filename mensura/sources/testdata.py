"""Sale lines, catalog and price index of the engine's model, from star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, product_id, order_id, date, month, quantity, amount, price, credit_note."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("long").alias("client_id"), F.col("l_partkey").cast("long").alias("product_id"), F.col("l_orderkey").cast("long").alias("order_id"),
        F.to_date("l_shipdate").alias("date"), F.trunc("l_shipdate", "MM").alias("month"), F.col("l_quantity").cast("double").alias("quantity"), amount.alias("amount"),
        F.try_divide(amount, F.col("l_quantity")).alias("price"), (F.col("l_returnflag") == "R").alias("credit_note"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, category, lab; a missing category has a name of its own."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").cast("long").alias("product_id"), F.coalesce("p_type", F.lit("SIN CATEGORIA")).alias("category"), F.col("p_brand").alias("lab"))


def price_index(spark: SparkSession, first: str = "1995-01-01", months: int = 83, monthly: float = 1.02) -> DataFrame:
    """month, index: a synthetic consumer price index, as callers may inject one."""
    return spark.range(months).select(F.add_months(F.lit(first).cast("date"), F.col("id").cast("int")).alias("month"), (100 * F.pow(F.lit(monthly), F.col("id"))).alias("index"))
