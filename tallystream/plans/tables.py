"""The tables in their roles: entity, time in whole seconds, amount, key and label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.functions.scalars import timestamp_seconds
from tallystream.functions.selection import quantiles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", "ts", timestamp_seconds(F.col("ts")).alias("t"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("*", timestamp_seconds(F.col("o_orderdate")).alias("t"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("*", timestamp_seconds(F.col("l_shipdate")).alias("t"))


def times_at(rows: DataFrame, shares: tuple[float, ...]) -> list[float]:
    """Exact quantiles of the column t; no task holds its distinct values."""
    return quantiles(rows.select(F.col("t").cast("double").alias("t")), {"t": F.col("t")}, list(shares))["t"]


#: SQL for the same roles.
EVENTS = "(SELECT *, epoch_us(ts) // 1000000 AS t FROM events)"
ORDERS = "(SELECT *, epoch_us(o_orderdate) // 1000000 AS t FROM orders)"
LINEITEM = "(SELECT *, epoch_us(l_shipdate) // 1000000 AS t FROM lineitem)"
