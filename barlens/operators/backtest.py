"""A dollar-neutral long/short lot simulation as relations.

Entries depend on the row alone and a lot's exit on its own prices alone, so lots are ranked, exploded over
their holding bars, and cut at the first stop: no loop over bars.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from barlens.operators.impact import Impact


@dataclass(frozen=True)
class Backtest:
    """Parameters, checked when set."""

    impact: Impact = field(default_factory=Impact)
    holding_bars: int = 4
    quantile: float = 0.1
    stop_loss: float = 0.08
    rebalance_every: int = 1
    gross_exposure: float = 1.0
    min_dollar_volume: float = 0.0
    max_weight: float = 0.1

    def __post_init__(self):
        if not 0.0 < self.quantile <= 0.5:
            raise ValueError("a side takes more than 0 and at most half of the symbols")
        if self.holding_bars < 1 or self.rebalance_every < 1:
            raise ValueError("lots are held, and books renewed, for one bar or more")
        if self.stop_loss <= 0.0:
            raise ValueError("the stop is a loss above 0")

    def grid(self, panel: DataFrame) -> DataFrame:
        """A dense panel (symbol, ts, score, close, dollar_volume) with bar numbers t, the last one, prices and costs."""
        times = panel.select("ts").distinct()
        numbered = times.withColumns({"t": (F.row_number().over(Window.orderBy("ts")) - 1).cast("int"), "last": (F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) - 1).cast("int")})
        return self.impact.liquidity(panel).join(numbered, "ts")

    def lots(self, grid: DataFrame) -> DataFrame:
        """(symbol, side, t, entry_time, notional, entry_price, qty, last): what is opened."""
        ok = (F.col("t") % self.rebalance_every == 0) & (F.col("t") < F.col("last")) & F.col("score").isNotNull() & (F.col("close") > 0) & (F.col("dollar_volume") >= self.min_dollar_volume) & F.col("vol").isNotNull() & (F.col("adv") > 0)
        ranked = grid.where(ok).withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("t")), "r": F.row_number().over(Window.partitionBy("t").orderBy("score", "symbol"))})
        k = F.least(F.greatest(F.lit(1), F.floor(self.quantile * F.col("n"))), F.expr("n div 2"))
        chosen = ranked.where("n >= 2").withColumn("k", k).withColumn("side", F.when(F.col("r") <= F.col("k"), 1).when(F.col("r") > F.col("n") - F.col("k"), -1)).where("side IS NOT NULL")
        cohorts = len(range(0, self.holding_bars, self.rebalance_every))  # that are open at a time
        notional = F.least(F.lit(self.max_weight * self.gross_exposure), F.lit(self.gross_exposure / cohorts / 2) / F.col("k"))
        sized = chosen.withColumn("notional", notional)
        filled = sized.withColumn("entry_price", self.impact.fill("side", "close", "notional", "adv", "vol"))
        return filled.select("symbol", "side", "t", F.col("ts").alias("entry_time"), "notional", "entry_price", (F.col("notional") / F.col("entry_price")).alias("qty"), "last", F.col("close").alias("entry_close"))

    def paths(self, grid: DataFrame, lots: DataFrame) -> DataFrame:
        """Every lot's holding bars up to its exit: k, px, and exit_k, reason."""
        span = lots.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(self.holding_bars), F.col("last") - F.col("t")))))
        at = grid.select("symbol", F.col("t").alias("at"), "px", "vol", "adv", F.col("ts").alias("at_time"))
        rows = span.withColumn("at", F.col("t") + F.col("k")).join(at, ["symbol", "at"])
        stop = F.col("side") * (F.col("px") / F.col("entry_price") - 1) <= -self.stop_loss
        lot = Window.partitionBy("symbol", "t", "side")
        rows = rows.withColumn("stop_k", F.min(F.when(stop, F.col("k"))).over(lot))
        rows = rows.withColumn("exit_k", F.coalesce("stop_k", F.least(F.lit(self.holding_bars), F.col("last") - F.col("t"))))
        reason = F.when(F.col("stop_k").isNotNull(), "stop").when(F.col("exit_k") >= self.holding_bars, "horizon").otherwise("final")
        return rows.where(F.col("k") <= F.col("exit_k")).withColumn("exit_reason", reason)

    def trades(self, paths: DataFrame) -> DataFrame:
        """The lots closed, one row each."""
        out = paths.where("k = exit_k").withColumn("exit_price", self.impact.fill(-F.col("side"), "px", F.col("qty") * F.col("px"), "adv", "vol"))
        out = out.withColumn("pnl", F.col("side") * F.col("qty") * (F.col("exit_price") - F.col("entry_price"))).withColumn("cost", F.col("qty") * F.col("entry_price"))
        side = F.when(F.col("side") > 0, "long").otherwise("short").alias("side")
        return out.select("symbol", side, "entry_time", F.col("at_time").alias("exit_time"), F.col("k").alias("bars_held"), "entry_price", "exit_price", F.col("cost").alias("notional"), "pnl", F.try_divide("pnl", "cost").alias("return"), "exit_reason", (F.col("notional") + F.col("qty") * F.col("exit_price")).alias("traded"), "at")

    def equity(self, grid: DataFrame, lots: DataFrame, paths: DataFrame, trades: DataFrame) -> DataFrame:
        """(ts, equity, ret) for every bar."""
        held = paths.where("k < exit_k").select("at", (F.col("side") * F.col("qty") * (F.col("px") - F.col("entry_price"))).alias("open"))
        fresh = lots.select(F.col("t").alias("at"), (F.col("side") * F.col("qty") * (F.col("entry_close") - F.col("entry_price"))).alias("open"))
        open_ = held.unionByName(fresh).groupBy("at").agg(F.sum("open").alias("open"))
        done = trades.groupBy("at").agg(F.sum("pnl").alias("pnl"))
        bars = grid.select("ts", F.col("t").alias("at")).distinct().join(open_, "at", "left").join(done, "at", "left").fillna(0.0, ["open", "pnl"])
        w = Window.orderBy("at")
        e = bars.withColumn("equity", self.gross_exposure + F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("open"))
        return e.select("ts", "equity", ((F.col("equity") - F.lag("equity").over(w)) / self.gross_exposure).alias("ret"))

    def stats(self, equity: DataFrame, trades: DataFrame) -> DataFrame:
        """One row of figures."""
        w = Window.orderBy("ts")
        e = equity.withColumns({"step": F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), "ts") / 1e6, "peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))})
        one = e.agg(((F.max_by("equity", "ts") - F.min_by("equity", "ts")) / self.gross_exposure).alias("total_return"), F.avg("ret").alias("m"), F.stddev("ret").alias("s"), F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"), (F.lit(365.25 * 86400) / F.expr("nullif(median(step), 0)")).alias("year"))
        win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        two = trades.agg(
            F.count(F.lit(1)).alias("n_trades"), zero(F.sum("traded") / self.gross_exposure).alias("turnover_x_gross"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"),
            zero(F.avg(win)).alias("avg_win"), zero(F.avg(loss)).alias("avg_loss"), F.avg("bars_held").alias("avg_bars_held"), F.avg((F.col("exit_reason") == "stop").cast("double")).alias("pct_stopped_out"),
            zero(F.sum(F.when(F.col("side") == "short", F.col("pnl")))).alias("short_pnl"), zero(F.sum(F.when(F.col("side") == "long", F.col("pnl")))).alias("long_pnl"),
        )
        return one.crossJoin(two).select("total_return", (F.col("m") * F.col("year")).alias("ann_return"), (F.try_divide("m", "s") * F.sqrt("year")).alias("sharpe"), "max_drawdown", *two.columns)

    def run(self, panel: DataFrame) -> dict[str, DataFrame]:
        """equity, trades and stats of a dense panel. Its grid and the lots' paths are persisted, as several results read them."""
        grid = self.grid(panel).persist(StorageLevel.MEMORY_AND_DISK)
        lots = self.lots(grid)
        paths = self.paths(grid, lots).persist(StorageLevel.MEMORY_AND_DISK)
        trades = self.trades(paths)
        equity = self.equity(grid, lots, paths, trades)
        return {"equity": equity, "trades": trades.drop("traded", "at"), "stats": self.stats(equity, trades)}
