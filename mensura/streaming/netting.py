"""Monthly netting of a stream of sale lines; an extension, as the engine itself is a nightly batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def netted_stream(lines: DataFrame, late: str = "60 days") -> DataFrame:
    """Units and revenue by product and month of a streaming frame of (ts, product_id, quantity, amount, credit_note).

    The month's beginning is the event time, so a month is closed, and its state dropped,
    once a row is seen of a month that begins more than ``late`` after it.
    """
    sign = F.when(F.col("credit_note"), -1.0).otherwise(1.0)
    rows = lines.withColumn("month", F.date_trunc("month", "ts")).withWatermark("month", late)
    return rows.groupBy("product_id", "month").agg(F.sum(sign * F.col("quantity")).alias("units"), F.sum(sign * F.col("amount")).alias("revenue"))
