"""Tables as files: declared schemas, a repository, the price index CSV with its expiry, checkpoints per cut, JSON sales."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "product_month": "product_id long, month date, units double, revenue double, avg_price double",
    "client_product_month": "client_id long, product_id long, month date, units double, revenue double",
    "catalog": "product_id long, category string, lab string, active boolean",
    "client_feature": "client_id long, main_category string, frequency string, annual_units double, annual_value double, trend_3m double, recency_days long, computed_on date",
    "price_anchor": "product_id long, price_today double, computed_on date",
    "level_index": "level string, level_id string, month date, index double",
}
WRITABLE = frozenset({"price_anchor", "level_index"})


class Repository(Protocol):
    def read(self, table: str) -> DataFrame: ...

    def write(self, table: str, df: DataFrame) -> None: ...


class FileRepository:
    """One Parquet table a name, read with its declared schema; only result tables are written."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.base}/{table}.parquet")

    def write(self, table: str, df: DataFrame) -> None:
        if table not in WRITABLE:
            raise ValueError(f"{table} is not written by the engine")
        names = [x.split()[0] for x in SCHEMAS[table].split(", ")]
        df.select(*names).write.mode("overwrite").parquet(f"{self.base}/{table}.parquet")


class JdbcRepository:
    """The same tables in a database; filters and columns are pushed into its queries."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options

    def read(self, table: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, table, properties=self.options)

    def write(self, table: str, df: DataFrame) -> None:
        if table not in WRITABLE:
            raise ValueError(f"{table} is not written by the engine")
        df.write.jdbc(self.url, table, mode="overwrite", properties=self.options)


class IndexExpired(ValueError):
    """The price index ends before the month that is asked for."""


def read_price_index(spark: SparkSession, path: str, until: str | None = None) -> DataFrame:
    """month, index up to the month of ``until``; raises IndexExpired beyond the last month."""
    rows = spark.read.schema("month date, index double").option("header", True).csv(path)
    if until is None:
        return rows
    limit = F.trunc(F.lit(until).cast("date"), "MM")
    if rows.where(F.col("month") >= limit).isEmpty():
        raise IndexExpired(f"no index for {until}")
    return rows.where(F.col("month") <= limit)


class Checkpoints:
    """A run's report by cut, with a manifest of whose run it is; only missing cuts are computed."""

    def __init__(self, spark: SparkSession, base: str, run_id: str):
        self.spark, self.base, self.run_id = spark, base.rstrip("/"), run_id
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        manifest = f"{self.base}/manifest.json"
        if self.fs.exists(self.path(manifest)):
            known = json.loads("".join(r.value for r in spark.read.text(manifest).collect()))["run_id"]
            if known != run_id:
                raise ValueError(f"the checkpoints are of run {known}, not {run_id}")
        else:
            out = self.fs.create(self.path(manifest))
            out.writeBytes(json.dumps({"run_id": run_id}))
            out.close()

    def cuts(self) -> set[str]:
        found = self.fs.globStatus(self.path(f"{self.base}/cut=*")) or []
        return {s.getPath().getName().removeprefix("cut=") for s in found if self.fs.exists(self.path(s.getPath().toString() + "/_SUCCESS"))}

    def save(self, cut: str, df: DataFrame) -> None:
        df.drop("cut").write.mode("overwrite").parquet(f"{self.base}/cut={cut}")

    def load(self, wanted: list[str]) -> DataFrame:
        missing = sorted(set(wanted) - self.cuts())
        if missing:
            raise ValueError(f"cuts without a checkpoint: {missing}")
        return self.spark.read.option("basePath", self.base).parquet(*[f"{self.base}/cut={c}" for c in wanted])


def sales_documents(lines: DataFrame) -> DataFrame:
    """One row a sale of the JSON contract, its lines nested in order."""
    quantity = F.when(F.col("credit_note"), -F.col("quantity")).otherwise(F.col("quantity"))
    line = F.struct(F.col("product_id").cast("string").alias("product_id"), quantity.alias("quantity"), F.round("price", 4).alias("price"), F.col("date"))
    total = F.round(F.sum(quantity * F.col("price")) * (1 + 1e-10), 2)
    return lines.groupBy("order_id", "client_id", "month").agg(total.alias("total"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(line)).alias("lines"))


def accepted_sales(documents: DataFrame, tolerance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Lines of sales whose lines add up, once a sale, and the rejected sales."""
    checked = documents.dropDuplicates(["order_id", "client_id", "month"]).withColumn("sum", F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["quantity"] * x["price"]))
    good = F.coalesce(F.abs(F.col("sum") - F.col("total")) <= tolerance, F.lit(False))
    return checked.where(good).select("order_id", "client_id", "month", F.inline("lines")), checked.where(~good)
