"""Order-book features of quotes and their bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions import columns as c
from barlens.functions.columns import ratio
from barlens.functions.windows import neighbours
from barlens.operators.bars import bar, fill_grid


def event_features(quotes: DataFrame) -> DataFrame:
    """(symbol, ts, id, ofi, obi, microprice_adj, rel_spread, mid, next_ts) of each quote; the first has no ofi, the last no next_ts."""
    names = ["best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty"]
    quotes = neighbours(quotes, names, ["ts"])
    pb, qb, pa, qa = (F.col(x) for x in names)
    pb0, qb0, pa0, qa0 = (F.col(f"prev_{x}") for x in names)

    def where(cond, x):
        return F.when(cond, x).otherwise(F.lit(0.0))

    ofi = where(pb >= pb0, qb) - where(pb <= pb0, qb0) - where(pa <= pa0, qa) + where(pa >= pa0, qa0)
    return quotes.select("symbol", "ts", "id", F.when(pb0.isNotNull(), ofi).alias("ofi"), c.imbalance().alias("obi"), c.microprice_adjustment().alias("microprice_adj"), c.relative_spread().alias("rel_spread"), c.mid().alias("mid"), "next_ts")


def quote_bars(events: DataFrame, freq: str, fill: bool = True) -> DataFrame:
    """(symbol, ts, ofi, obi, microprice_adj, rel_spread, update_intensity, mid_close); levels weigh by time until the next quote.

    The last quote of a symbol weighs its median dwell time; the weights of missing values count too. Where events have no
    next_ts it is looked up.
    """
    timed = events if "next_ts" in events.columns else neighbours(events, behind=["ts"])
    timed = timed.withColumn("dwell", F.timestamp_diff("MICROSECOND", "ts", "next_ts") / 1e6)
    medians = timed.groupBy("symbol").agg(F.median("dwell").alias("usual"))
    timed = timed.join(medians, "symbol").withColumn("dwell", F.greatest(F.lit(0.0), F.coalesce("dwell", "usual")))
    timed = timed.withColumns({"ts_tick": F.col("ts"), "ts": bar(freq)})

    def weighted(x: str):
        return ratio(F.sum(F.col(x) * F.col("dwell")), F.sum("dwell")).alias(x)

    bars = timed.groupBy("symbol", "ts").agg(
        F.sum("ofi").alias("ofi"), weighted("obi"), weighted("microprice_adj"), weighted("rel_spread"), F.count("mid").alias("update_intensity"),
        F.max_by("mid", F.when(F.col("mid").isNotNull(), F.struct("ts_tick", "id"))).alias("mid_close"),
    )
    return fill_grid(bars, freq, ("update_intensity",)) if fill else bars
