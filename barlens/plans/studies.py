"""Panels, and the studies that go from ticks or bars to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from barlens.functions import columns as c
from barlens.functions.columns import signed_volume
from barlens.functions.windows import across, along, normalized, percentile_rank, zscore
from barlens.operators import attribution, bars, book, diagnostics, latent, memory, metaorder, residual
from barlens.operators.backtest import Backtest

FLOW_FEATURES = ["tfi", "trade_intensity", "runup", "runup_rank_velocity"]
#: The figures of a backtest's report, in its order.
REPORTED = ("total_return", "ann_return", "sharpe", "max_drawdown", "n_trades", "hit_rate", "avg_win", "avg_loss", "avg_bars_held", "pct_stopped_out", "short_pnl", "long_pnl", "turnover_x_gross")
BOOK_FEATURES = ["ofi", "obi", "microprice_adj", "rel_spread", "update_intensity"]


def trade_panel(trades: DataFrame, freq: str = "1h", runup_window: int = 8, velocity_window: int = 4, normalize: str | None = "zscore") -> DataFrame:
    """A dense panel of flow features; close and dollar_volume stay as they are."""
    p = bars.densify(bars.trade_bars(trades, freq))
    p = p.withColumn("ln", F.when(F.col("close") > 0, F.ln("close"))).withColumn("trail", F.col("ln") - F.lag("ln", runup_window).over(along()))
    p = p.withColumn("runup", F.col("trail") - F.median("trail").over(across())).withColumn("rr", percentile_rank("runup"))
    p = p.withColumns({"runup_rank_velocity": F.col("rr") - F.lag("rr", velocity_window).over(along()), "trade_intensity": F.log1p("trade_intensity")})
    return normalized(p, FLOW_FEATURES, normalize).select("symbol", "ts", *FLOW_FEATURES, "dollar_volume", "close")


def book_panel(quotes: DataFrame, freq: str = "15min", normalize: str | None = "zscore") -> DataFrame:
    """A dense panel of order-book features; mid_close stays as it is."""
    p = bars.densify(book.quote_bars(book.event_features(quotes), freq)).withColumn("update_intensity", F.log1p("update_intensity"))
    return normalized(p, BOOK_FEATURES, normalize).select("symbol", "ts", *BOOK_FEATURES, "mid_close")


def split_time(panel: DataFrame, share: float, embargo: int = 0):
    """The last bar of training: `embargo` bars before the one at place int(n x share) of all bars; needs 10 bars."""
    return _splits(panel, share, embargo)[0]


def _splits(panel: DataFrame, share: float, embargo: int) -> tuple:
    """(last bar of training, the bar after which rows are out of sample): only these reach the driver."""
    times = panel.select("ts").distinct()
    n = times.count()
    if n < 10:
        raise ValueError("at least 10 bars are needed")
    end = min(int(n * share), n - 1)
    first = max(0, end - embargo)
    found = times.withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1).where(F.col("i").isin(first, end)).orderBy("i").collect()
    return found[0]["ts"], found[-1]["ts"]


def scored(panel: DataFrame, features: list[str], train_share: float = 0.6, seed: int = 7, embargo: int = 0) -> tuple[DataFrame, object]:
    """The panel with a forest's score, and the bar after which rows are out of sample; training may end earlier.

    The panel is persisted (memory and disk), as the fit reads it several times; `unpersist` it when nothing reads it any more.
    """
    panel = panel.persist(StorageLevel.MEMORY_AND_DISK)
    last, end = _splits(panel, train_share, embargo)
    return latent.fit_forest(panel.where(F.col("ts") <= F.lit(last)), features, seed).transform(panel), end


def diagnosed(panel: DataFrame, train_end, n: int = 4) -> dict[str, DataFrame]:
    """Rank skill (also of the flipped score: mean and ratio only), decile tails and their verdict after training."""
    out = diagnostics.forward_return(panel.where(F.col("ts") > F.lit(train_end)), n)
    summary = diagnostics.ic_summary(diagnostics.information_coefficient(out))
    deciles = diagnostics.decile_audit(out)
    return {"ic": summary, "ic_flipped": summary.withColumns({"ic_mean": -F.col("ic_mean"), "ic_ir": -F.col("ic_ir")}), "deciles": deciles, "verdict": diagnostics.audit_verdict(deciles)}


def run_backbone(trades: DataFrame, freq: str = "1h", n: int = 4, train_share: float = 0.6, runup_window: int = 8, velocity_window: int = 4, normalize: str | None = "zscore") -> dict[str, DataFrame]:
    """Trades to rank skill: `diagnosed`, and the scored panel."""
    panel, end = scored(trade_panel(trades, freq, runup_window, velocity_window, normalize), FLOW_FEATURES, train_share)
    return diagnosed(panel, end, n) | {"panel": panel}


def run_phase1(quotes: DataFrame, freq: str = "15min", n: int = 4, train_share: float = 0.6, normalize: str | None = "zscore") -> dict[str, DataFrame]:
    """Quotes to rank skill: `diagnosed`, and the scored panel."""
    panel, end = scored(book_panel(quotes, freq, normalize), BOOK_FEATURES, train_share)
    panel = panel.withColumnRenamed("mid_close", "close")
    return diagnosed(panel, end, n) | {"panel": panel}


def run_strategy(trades: DataFrame, freq: str = "1h", train_share: float = 0.6, backtest: Backtest | None = None, runup_window: int = 8, velocity_window: int = 4) -> dict[str, DataFrame]:
    """Trades to a simulated book after training: `Backtest.run`, the report of its figures, and the scored panel."""
    panel, end = scored(trade_panel(trades, freq, runup_window, velocity_window), FLOW_FEATURES, train_share)
    found = (backtest or Backtest()).run(panel.where(F.col("ts") > F.lit(end)))
    return found | {"report": report(found["stats"]), "panel": panel}


def report(stats: DataFrame) -> DataFrame:
    """(place, name, value, note): the figures of a backtest, one row each; a note where the short side loses."""
    names = [c for c in REPORTED if c in stats.columns]
    note = F.when((F.lit("short_pnl") == F.col("name")) & (F.col("value") <= 0), "the short side doesn't pay")
    rows = stats.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])).alias("place", "x"))
    return rows.select("place", "x.name", "x.value").withColumn("note", note)


def write(df: DataFrame, path: str, by: str | None = None) -> None:
    """A result as Parquet, in a folder for each value of `by` if given."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def kline_features(klines: DataFrame, sectors: DataFrame, beta_window: int = 120, vol_weight_window: int = 48, rank_window: int = 6) -> DataFrame:
    """Residual, its rank and velocity, illiquidity and wick, the last two as z-scores, on a dense kline panel."""
    p = residual.residuals(residual.factors(bars.densify(klines), sectors, vol_weight_window), beta_window)
    p = residual.rank_trajectory(p, rank_window).withColumns({"illiquidity": c.illiquidity(), "wick": c.wick()})
    return p.withColumns({x: zscore(x) for x in ("illiquidity", "wick")})


def run_pipeline(klines: DataFrame, sectors: DataFrame, n: int = 6, train_share: float = 0.6, **windows: int) -> dict[str, DataFrame]:
    """Klines to rank skill: needs symbol, ts, open, high, low, close and volume."""
    missing = {"symbol", "ts", "open", "high", "low", "close", "volume"} - set(klines.columns)
    if missing:
        raise ValueError(f"klines lack {', '.join(sorted(missing))}")
    panel, end = scored(kline_features(klines, sectors, **windows), ["residual", "rank_velocity", "illiquidity", "wick"], train_share)
    return diagnosed(panel, end, n) | {"scores": panel.select("symbol", "ts", "score")}


def run_propagator(trades: DataFrame, freq: str = "1min", max_lag: int = 150, n_clips: int = 20) -> dict[str, DataFrame]:
    """Price response and flow memory of each symbol. `audit` has a row for each symbol, with `status`: ok, or why not."""
    series = memory.bar_series(bars.flow_bars(trades, freq)).persist(StorageLevel.MEMORY_AND_DISK)
    response = memory.response(series, max_lag)
    state = memory.status(trades.select("symbol"), series.groupBy("symbol").agg(F.var_pop("flow").alias("v")).select("symbol", F.when(F.col("v") < 1e-15, "flow does not vary").otherwise("ok").alias("status")), "fewer than two bars")
    good = state.where("status = 'ok'").select("symbol")
    only = lambda df: df.join(good, "symbol", "left_semi")
    audit = state.join(memory.audit(series, max_lag), "symbol", "left")
    audit = audit.select("symbol", "status", *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in audit.columns if c not in ("symbol", "status")])
    return {"response": only(response), "flow_acf": only(memory.autocorrelation(series, "flow", max_lag)), "audit": audit, "round_trip": only(memory.round_trip(response, n_clips))}


def run_flow_memory(trades: DataFrame, freq: str = "1min", max_lag: int = 500) -> dict[str, DataFrame]:
    """Long memory of each symbol's trade signs. `status`: ok, or why the autocorrelations are 0; medians over all symbols."""
    signs = trades.groupBy("symbol").agg(F.sum((signed_volume() != 0).cast("int")).alias("n"), F.min(F.signum(signed_volume())).alias("a"), F.max(F.signum(signed_volume())).alias("b"))
    state = signs.select("symbol", F.when(F.coalesce("n", F.lit(0)) < max_lag + 2, "too few trades for the lags").when(F.col("a") == F.col("b"), "signs do not vary").otherwise("ok").alias("status"))
    summary = state.join(memory.memory_summary(trades, bars.flow_bars(trades, freq), max_lag), "symbol", "left").persist(StorageLevel.MEMORY_AND_DISK)
    medians = summary.agg(*[F.median(c).alias(c) for c in ("hurst_flow", "hurst_prices", "h_gap")])
    return {"summary": summary, "acf": memory.sign_acf(trades, max_lag), "medians": medians}


def run_attribution(trades: DataFrame, freq: str = "1min", horizons: tuple[int, ...] = attribution.HORIZONS, cutoff: int = 32) -> dict[str, DataFrame]:
    """Where prices go after each symbol's flow: markout, its permanent and transient part, adverse selection."""
    b = bars.flow_bars(trades, freq).persist(StorageLevel.MEMORY_AND_DISK)
    table = attribution.markout(b, horizons)
    return {"markout": table, "split": attribution.permanent_transient(table, cutoff), "adverse_selection": attribution.adverse_selection(b, horizons)}


def run_metaorder(trades: DataFrame, freq: str = "5min", window_bars: int = 12, threshold: float = 0.6, least: int = 4) -> dict[str, DataFrame]:
    """Traces of large orders: bars, windows of pressure, and a row of figures for each symbol."""
    f = metaorder.features(trades, freq, window_bars, threshold).persist(StorageLevel.MEMORY_AND_DISK)
    windows = metaorder.pressure_windows(f, threshold, least)
    counts = windows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_metaorder_windows"), F.round(F.avg("n_bars"), 1).alias("avg_window_bars"), F.max("n_bars").alias("max_window_bars"))
    mean = lambda x, name: F.round(F.avg(x), 3).alias(name)
    per = f.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), mean("pressure_score", "mean_pressure_score"), mean(F.abs("tfi"), "mean_abs_tfi"), mean("interval_entropy", "mean_interval_entropy"))
    stats = per.join(counts, "symbol", "left").fillna(0, ["n_metaorder_windows", "avg_window_bars", "max_window_bars"])
    return {"features": f, "windows": windows, "universe_stats": stats.select("symbol", "n_bars", "n_metaorder_windows", "avg_window_bars", "max_window_bars", "mean_pressure_score", "mean_abs_tfi", "mean_interval_entropy")}
