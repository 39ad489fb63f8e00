"""Ticks to bars, and bars to dense panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from barlens.functions.columns import number, ratio, signed_volume

#: Bar lengths: those that divide a day, and a week from Monday.
STEPS = {"1min": "1 minute", "5min": "5 minutes", "15min": "15 minutes", "30min": "30 minutes", "1h": "1 hour", "4h": "4 hours", "D": "1 day", "week": "7 days"}


def bar(freq: str, ts: str = "ts") -> Column:
    """The start of a tick's bar."""
    if freq not in STEPS:
        raise ValueError(f"freq must be one of {', '.join(STEPS)}")
    return F.date_trunc("week", ts).cast("date") if freq == "week" else F.window(ts, STEPS[freq])["start"]


def fill_grid(bars: DataFrame, freq: str, zero: tuple[str, ...] = ()) -> DataFrame:
    """Add the empty bars between each symbol's first and last; `zero` columns are 0 there, others NULL.

    Each bar fills the gap behind it, so that the bars are read once.
    """
    names = [c for c in bars.columns if c not in ("symbol", "ts")]
    full = bars.withColumnRenamed("ts", "_own").withColumn("_next", F.lead("_own").over(Window.partitionBy("symbol").orderBy("_own")))
    gap = F.filter(F.sequence("_own", "_next", F.expr(f"INTERVAL {STEPS[freq]}")), lambda t: t < F.col("_next"))
    full = full.withColumn("ts", F.explode(F.coalesce(gap, F.array("_own"))))
    values = [F.when(F.col("ts") == F.col("_own"), F.col(c)).alias(c) for c in names]
    return full.select("symbol", "ts", *values).fillna(0, subset=list(zero)) if zero else full.select("symbol", "ts", *values)


def densify(bars: DataFrame) -> DataFrame:
    """Every symbol at every time that any symbol has: what row windows need. Both lists are distinct keys.

    The bars are persisted (memory and disk), as they are read three times; `clearCache` of the session's catalog frees them.
    """
    bars = bars.persist(StorageLevel.MEMORY_AND_DISK)
    return bars.select("ts").distinct().crossJoin(bars.select("symbol").distinct()).join(bars, ["symbol", "ts"], "left")


def last_price(price: str = "price") -> Column:
    return F.max_by(number(price), F.when(number(price).isNotNull(), F.struct("ts_tick", "id")))


def counted(trades: DataFrame) -> DataFrame:
    """Trades whose quantity is a number; the others are rejected, as no bar can count them."""
    return trades.withColumn("quantity", number("quantity")).where("quantity IS NOT NULL")


def trade_sums() -> list[Column]:
    """What trade bars hold of their ticks (ts_tick, id, price, quantity, signed)."""
    return [F.sum("signed").alias("signed"), F.sum("quantity").alias("volume"), F.count(number("price")).alias("trade_intensity"), F.sum(number("price") * F.col("quantity")).alias("dollar_volume"), last_price().alias("close")]


def trade_bars(trades: DataFrame, freq: str, fill: bool = True) -> DataFrame:
    """(symbol, ts, tfi, trade_intensity, dollar_volume, close) from (symbol, ts, id, price, quantity, is_buyer_maker)."""
    ticks = counted(trades).withColumns({"ts_tick": F.col("ts"), "ts": bar(freq), "signed": signed_volume()})
    sums = ticks.groupBy("symbol", "ts").agg(*trade_sums())
    bars = sums.select("symbol", "ts", ratio("signed", "volume").alias("tfi"), "trade_intensity", "dollar_volume", "close")
    return fill_grid(bars, freq, ("trade_intensity",)) if fill else bars


def ohlcv_bars(trades: DataFrame, freq: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume, dollar_volume, n)."""
    ticks = counted(trades).withColumns({"price": number("price"), "ts_tick": F.col("ts"), "ts": bar(freq)})
    first = F.min_by("price", F.when(F.col("price").isNotNull(), F.struct("ts_tick", "id")))
    return ticks.groupBy("symbol", "ts").agg(
        first.alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last_price().alias("close"),
        F.sum("quantity").alias("volume"), F.sum(F.col("price") * F.col("quantity")).alias("dollar_volume"), F.count(F.lit(1)).alias("n"),
    )


def flow_bars(trades: DataFrame, freq: str) -> DataFrame:
    """(symbol, ts, flow, close): summed signed volume (0 in empty bars) and the last price so far."""
    from barlens.functions.windows import carried

    ticks = trades.withColumns({"ts_tick": F.col("ts"), "ts": bar(freq), "signed": signed_volume()})
    sums = ticks.groupBy("symbol", "ts").agg(F.sum("signed").alias("flow"), last_price().alias("close"))
    return fill_grid(sums, freq, ("flow",)).withColumn("close", carried("close"))
