"""Traces of large orders worked in pieces: participation, size variation, timing entropy, sustained pressure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.columns import ratio, signed_volume
from barlens.functions.windows import along, neighbours
from barlens.operators.bars import bar, fill_grid


def participation(trades: DataFrame, freq: str) -> DataFrame:
    """(symbol, ts, buy_participation, sell_participation, tfi, total_volume, size_cv) of each bar; empty bars are NULL."""
    ticks = trades.select("symbol", bar(freq).alias("ts"), signed_volume().alias("sv"), F.abs(signed_volume()).alias("q"))
    mean = F.avg("q")
    sums = ticks.groupBy("symbol", "ts").agg(
        F.sum(F.greatest("sv", F.lit(0.0))).alias("buy"), F.sum(F.greatest(-F.col("sv"), F.lit(0.0))).alias("sell"), F.sum("q").alias("all"),
        F.when((F.count("q") >= 2) & (mean >= 1e-12), F.stddev_pop("q") / mean).alias("size_cv"),
    )
    bars = sums.select("symbol", "ts", ratio("buy", "all").alias("buy_participation"), ratio("sell", "all").alias("sell_participation"), ratio(F.col("buy") - F.col("sell"), "all").alias("tfi"), F.when(F.col("all") != 0, F.col("all")).alias("total_volume"), "size_cv")
    return fill_grid(bars, freq)


def interval_entropy(trades: DataFrame, freq: str) -> DataFrame:
    """(symbol, ts, interval_entropy): bits of the histogram of a bar's gaps between trades, min(10, gaps) equal bins.

    A gap belongs to the bar of its later trade; fewer than three gaps give NULL. Bin edges are those of a
    computed grid, so a value that rounding puts on the wrong side of its edge moves by one bin.
    """
    gap = F.timestamp_diff("MICROSECOND", "prev_ts", "ts") / 1000.0
    gaps = neighbours(trades.select("symbol", "ts", "id"), ["ts"]).select("symbol", bar(freq).alias("bar"), F.greatest(gap, F.lit(0.0)).alias("g"), gap.isNotNull().alias("has")).where("has")
    own = Window.partitionBy("symbol", "bar")
    g = gaps.withColumns({"n": F.count(F.lit(1)).over(own), "mn": F.min("g").over(own), "mx": F.max("g").over(own)}).where("n >= 3")
    g = g.withColumn("nb", F.least(F.col("n"), F.lit(10)).cast("int")).withColumn("step", (F.col("mx") - F.col("mn")) / F.col("nb"))
    j = F.least(F.floor(F.try_divide(F.col("g") - F.col("mn"), F.col("mx") - F.col("mn")) * F.col("nb")).cast("int"), F.col("nb") - 1)
    g = g.withColumn("j", F.coalesce(j, F.lit(0)))
    edge = lambda i: F.when(i == F.col("nb"), F.col("mx")).otherwise(F.col("mn") + i * F.col("step"))
    g = g.withColumn("j", F.when(F.col("g") < edge(F.col("j")), F.col("j") - 1).otherwise(F.col("j")))
    g = g.withColumn("j", F.when((F.col("g") >= edge(F.col("j") + 1)) & (F.col("j") != F.col("nb") - 1) & (F.col("mx") > F.col("mn")), F.col("j") + 1).otherwise(F.col("j")))
    bins = g.groupBy("symbol", "bar", "n", "j").agg((F.count(F.lit(1)) / F.col("n")).alias("p"))
    return bins.groupBy("symbol", F.col("bar").alias("ts")).agg((-F.sum(F.col("p") * F.log2("p")) + 0.0).alias("interval_entropy"))


def features(trades: DataFrame, freq: str = "5min", window_bars: int = 12, threshold: float = 0.6) -> DataFrame:
    """Participation, size_cv, interval_entropy and pressure_score, the share of pressured bars in the window."""
    p = participation(trades, freq).join(interval_entropy(trades, freq), ["symbol", "ts"], "left")
    hit = (F.coalesce(F.abs("tfi"), F.lit(0.0)) >= threshold).cast("double")
    return p.withColumn("pressure_score", F.avg(hit).over(along().rowsBetween(-(window_bars - 1), 0)))


def pressure_windows(bars: DataFrame, threshold: float = 0.6, least: int = 4) -> DataFrame:
    """(symbol, start, end, direction, n_bars, avg_tfi, max_tfi, total_volume): longest runs of pressured bars of one sign."""
    b = bars.select("symbol", "ts", F.coalesce("tfi", F.lit(0.0)).alias("tfi"), F.coalesce("total_volume", F.lit(0.0)).alias("v"))
    b = b.withColumn("state", F.when(F.abs("tfi") >= threshold, F.signum("tfi").cast("int")).otherwise(F.lit(9)))
    b = b.withColumn("new", (~F.col("state").eqNullSafe(F.lag("state").over(along()))).cast("int"))
    b = b.withColumn("run", F.sum("new").over(along().rowsBetween(Window.unboundedPreceding, 0))).where("state <> 9")
    runs = b.groupBy("symbol", "run").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.min("state").alias("direction"), F.count(F.lit(1)).alias("n_bars"),
        F.round(F.avg(F.abs("tfi")), 3).alias("avg_tfi"), F.round(F.max(F.abs("tfi")), 3).alias("max_tfi"), F.round(F.sum("v"), 2).alias("total_volume"),
    )
    return runs.where(F.col("n_bars") >= least).drop("run")
