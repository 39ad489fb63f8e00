"""Where the price goes after flow: markout, permanent and transient part, adverse selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.windows import along

HORIZONS = (1, 2, 4, 8, 16, 32, 64, 128)


def _moves(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(symbol, flow, lag, r) of flow bars, for lags that have a later bar."""
    b = bars.withColumn("lp", F.when(F.col("close") > 0, F.ln("close")))
    b = b.withColumns({f"r{h}": F.lead("lp", h).over(along()) - F.col("lp") for h in horizons})
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("lag"), F.col(f"r{h}").alias("r")) for h in horizons])).alias("x")
    return b.select("symbol", "flow", pairs).select("symbol", "flow", "x.lag", "x.r").where("r IS NOT NULL")


def markout(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(symbol, lag, mean_markout, std_markout, n_obs, t_stat, cumulative); lags with under 20 bars of flow are left out."""
    m = _moves(bars, horizons).where("flow <> 0").withColumn("m", F.signum("flow") * F.col("r"))
    t = m.groupBy("symbol", "lag").agg(F.avg("m").alias("mean_markout"), F.stddev_pop("m").alias("std_markout"), F.count(F.lit(1)).alias("n_obs")).where("n_obs >= 20")
    t = t.withColumn("t_stat", F.when(F.col("std_markout") > 0, F.col("mean_markout") / (F.col("std_markout") / F.sqrt("n_obs"))).otherwise(0.0))
    return t.withColumn("cumulative", F.sum("mean_markout").over(Window.partitionBy("symbol").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)))


def permanent_transient(table: DataFrame, cutoff: int = 32) -> DataFrame:
    """(symbol, permanent_component, transient_component, peak_lag, reversion_fraction, interpretation) of a markout table."""
    t = table.groupBy("symbol").agg(F.max("mean_markout").alias("peak"), F.max_by("lag", F.struct("mean_markout", -F.col("lag"))).alias("peak_lag"), F.avg(F.when(F.col("lag") >= cutoff, F.col("mean_markout"))).alias("plateau"))
    t = t.withColumn("plateau", F.coalesce("plateau", "peak")).withColumn("transient", F.greatest(F.lit(0.0), F.col("peak") - F.col("plateau")))
    t = t.withColumn("share", F.col("transient") / F.greatest(F.abs("peak"), F.lit(1e-15)))
    said = F.when(F.col("share") > 0.6, "impact-dominated").when(F.col("share") < 0.2, "alpha-dominated").otherwise("mixed")
    return t.select("symbol", F.round("plateau", 8).alias("permanent_component"), F.round("transient", 8).alias("transient_component"), "peak_lag", F.round("share", 3).alias("reversion_fraction"), said.alias("interpretation"))


def adverse_selection(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(symbol, lag, adverse_selection): mean move after net-buy bars; lags with under 10 of them are left out."""
    t = _moves(bars, horizons).where("flow > 0").groupBy("symbol", "lag").agg(F.avg("r").alias("adverse_selection"), F.count(F.lit(1)).alias("n"))
    return t.where("n >= 10").select("symbol", "lag", F.round("adverse_selection", 8).alias("adverse_selection"))


