"""Trade bars over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.columns import ratio, signed_volume
from barlens.operators.bars import STEPS, counted, trade_sums


def trade_bars(trades: DataFrame, freq: str, late: str = "10 minutes") -> DataFrame:
    """The bars of `operators.bars.trade_bars` without empty ones, each final once the watermark has passed it.

    `trades` has (symbol, ts TIMESTAMP, id, price, quantity, is_buyer_maker); ticks later than `late` are dropped.
    """
    ticks = counted(trades).withWatermark("ts", late).withColumn("signed", signed_volume()).withColumn("ts_tick", F.col("ts"))
    sums = ticks.groupBy("symbol", F.window("ts", STEPS[freq])).agg(*trade_sums())
    return sums.select("symbol", F.col("window.start").alias("ts"), ratio("signed", "volume").alias("tfi"), "trade_intensity", "dollar_volume", "close")
