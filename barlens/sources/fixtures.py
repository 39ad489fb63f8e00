"""The driver's tables as ticks, quotes, bars and sectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with microsecond times: 20 symbols, 30 days."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("symbol"), "ts", F.col("event_id").alias("id"), (100 + F.col("value")).alias("price"),
        F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("quantity"), F.col("event_type").isin("click", "error").alias("is_buyer_maker"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bids and asks of 20 symbols."""
    level = (100 + F.floor(F.col("value") / 20)).cast("double")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("symbol"), "ts", F.col("event_id").alias("id"),
        (level - F.lit(0.01) * (1 + F.col("event_id") % 2)).alias("best_bid_price"), F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("best_bid_qty"),
        (level + F.lit(0.01) * (1 + F.col("event_id") % 3)).alias("best_ask_price"), ((F.col("event_id") * 7) % 50).cast("double").alias("best_ask_qty"),
    )


def item_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with daily times: 25 symbols over seven years; `id` is an order within symbol and day."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("s_nationkey").alias("symbol"), F.col("l_shipdate").alias("ts"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_linestatus") == "O").alias("is_buyer_maker"),
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("symbol"), F.col("n_regionkey").cast("string").alias("sector"))
