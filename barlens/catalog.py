"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions import columns as c
from barlens.functions import windows as w
from barlens.operators import attribution, bars, book, diagnostics, memory, metaorder, residual
from barlens.operators.backtest import Backtest
from barlens.operators.impact import Impact
from barlens.plans import studies
from barlens.plans.oracles import ORACLES
from barlens.sources import fixtures as fx

FLAGSHIP = "tfi_zscore_weekly"
#: Parameters of the queries, as in their SQL.
BETA, VOL, LAGS = 26, 12, 60
#: The reference's own ranges of lags: of trades' signs, and of bars.
SIGN_LAGS, BAR_LAGS = 500, 150

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero; sums of doubles differ in their last bits from run to run."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n, t in df.dtypes if t == "double"})


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, d: tidy(f(spark, d))
    return f


def weekly(spark: SparkSession, d: str) -> DataFrame:
    return bars.densify(bars.ohlcv_bars(fx.item_trades(spark, d), "week"))


def raw_weekly(spark: SparkSession, d: str) -> DataFrame:
    return bars.ohlcv_bars(fx.item_trades(spark, d), "week")


def flow(spark: SparkSession, d: str) -> DataFrame:
    return bars.flow_bars(fx.event_trades(spark, d), "1h")


def book_events(spark: SparkSession, d: str) -> DataFrame:
    return book.event_features(fx.quotes(spark, d))


def factor_panel(spark: SparkSession, d: str) -> DataFrame:
    return residual.factors(weekly(spark, d), fx.sectors(spark, d), VOL)


def residual_panel(spark: SparkSession, d: str) -> DataFrame:
    return residual.rank_trajectory(residual.residuals(factor_panel(spark, d), BETA), 6)


def liquid(spark: SparkSession, d: str) -> DataFrame:
    return Impact().liquidity(weekly(spark, d))


def score_panel(spark: SparkSession, d: str) -> DataFrame:
    """A score that SQL can give too: the return of the last four weeks, the other way round."""
    p = weekly(spark, d)
    return p.withColumn("score", F.round(1 - c.ratio("close", F.lag("close", 4).over(w.along())), 9))


def _with_forward(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.forward_return(score_panel(spark, d), 2)


@query
def tfi_zscore_weekly(spark, d):
    b = bars.trade_bars(fx.item_trades(spark, d), "week", fill=False)
    return b.select("symbol", "ts", "tfi", w.zscore("tfi").alias("tfi_z"))


@query
def tfi_bars(spark, d):
    return bars.trade_bars(fx.event_trades(spark, d), "1h")


@query
def ohlcv_bars(spark, d):
    return raw_weekly(spark, d)


@query
def trade_panel_zscore(spark, d):
    return studies.trade_panel(fx.item_trades(spark, d), "week")


@query
def trade_panel_rank(spark, d):
    return studies.trade_panel(fx.item_trades(spark, d), "week", normalize="rank")


@query
def runup_rank_velocity(spark, d):
    return studies.trade_panel(fx.item_trades(spark, d), "week", normalize=None).select("symbol", "ts", "runup", "runup_rank_velocity", "trade_intensity")


@query
def kline_geometry(spark, d):
    return raw_weekly(spark, d).select("symbol", "ts", (c.illiquidity() * 1e6).alias("illiquidity"), c.wick().alias("wick"), c.upper_wick().alias("upper_wick"))


@query
def cross_section(spark, d):
    b = raw_weekly(spark, d)
    return b.select("symbol", "ts", w.zscore("close").alias("z"), w.percentile_rank("close").alias("pct_rank"), w.winsorized("close", 0.1, 0.9).alias("winsorized"), w.extremity("close", 0.9).alias("extreme"))


@query
def ofi_events(spark, d):
    return book_events(spark, d).select("symbol", "id", "ofi")


@query
def book_features(spark, d):
    return book_events(spark, d).select("symbol", "id", "obi", "microprice_adj", "rel_spread", "mid")


@query
def ofi_bars(spark, d):
    return book.quote_bars(book_events(spark, d), "1h")


@query
def book_panel(spark, d):
    return studies.book_panel(fx.quotes(spark, d), "4h")


@query
def market_median(spark, d):
    return factor_panel(spark, d).select("ts", "market").distinct()


@query
def sector_loo(spark, d):
    return factor_panel(spark, d).select("symbol", "ts", "ret", "sector_index")


@query
def residuals(spark, d):
    return residual_panel(spark, d).select("symbol", "ts", "residual")


@query
def rank_trajectory(spark, d):
    return residual_panel(spark, d).withColumn("residual", F.round("residual", 9)).transform(lambda p: residual.rank_trajectory(p, 6)).select("symbol", "ts", "rank", "rank_velocity")


@query
def rolling_vol_adv(spark, d):
    return liquid(spark, d).select("symbol", "ts", "vol", "adv")


@query
def impact_costs(spark, d):
    i, p = Impact(), liquid(spark, d)
    n = F.lit(1e4)
    return p.select("symbol", "ts", i.slippage_bps(n, "adv", "vol").alias("slippage_bps"), i.execute(F.lit(1), "px", n, "adv", "vol").alias("buy"), i.fill(F.lit(-1), "px", n, "adv", "vol").alias("sell_fill"), i.round_trip_bps(n, "adv", "vol").alias("round_trip_bps"))


@query
def participation(spark, d):
    return metaorder.participation(fx.event_trades(spark, d), "1h")


@query
def interval_entropy(spark, d):
    return metaorder.interval_entropy(fx.event_trades(spark, d), "4h")


@query
def metaorder_features(spark, d):
    return metaorder.features(fx.event_trades(spark, d), "4h", 6, 0.3)


@query
def pressure_windows(spark, d):
    return metaorder.pressure_windows(metaorder.participation(fx.event_trades(spark, d), "1h"), 0.5, 2)


@query
def forward_return(spark, d):
    return _with_forward(spark, d).select("symbol", "ts", "fwd")


@query
def information_coefficient(spark, d):
    return diagnostics.information_coefficient(_with_forward(spark, d))


@query
def ic_rolling(spark, d):
    return diagnostics.information_coefficient(_with_forward(spark, d), 8)


@query
def ic_summary(spark, d):
    return diagnostics.ic_summary(diagnostics.information_coefficient(_with_forward(spark, d)))


@query
def decile_audit(spark, d):
    return diagnostics.decile_audit(_with_forward(spark, d))


@query
def lots(spark, d):
    b = Backtest()
    g = b.grid(score_panel(spark, d))
    return b.trades(b.paths(g, b.lots(g))).drop("traded", "at")


@query
def equity(spark, d):
    return Backtest().run(score_panel(spark, d))["equity"]


@query
def bt_stats(spark, d):
    return Backtest().run(score_panel(spark, d))["stats"]


@query
def markout_profile(spark, d):
    return attribution.markout(flow(spark, d))


@query
def perm_transient(spark, d):
    return attribution.permanent_transient(attribution.markout(flow(spark, d)))


@query
def adverse_selection(spark, d):
    return attribution.adverse_selection(flow(spark, d))


@query
def response_function(spark, d):
    return memory.response(memory.bar_series(flow(spark, d)), LAGS)


@query
def flow_acf(spark, d):
    return memory.autocorrelation(memory.bar_series(flow(spark, d)), "flow", LAGS)


@query
def response_function_150(spark, d):
    return memory.response(memory.bar_series(flow(spark, d)), BAR_LAGS)


@query
def flow_acf_150(spark, d):
    return memory.autocorrelation(memory.bar_series(flow(spark, d)), "flow", BAR_LAGS)


@query
def sign_acf(spark, d):
    return memory.sign_acf(fx.event_trades(spark, d), LAGS)


@query
def sign_acf_500(spark, d):
    return memory.sign_acf(fx.event_trades(spark, d), SIGN_LAGS)


@query
def power_law_500(spark, d):
    return memory.power_law(memory.sign_acf(fx.event_trades(spark, d), SIGN_LAGS))


@query
def power_law(spark, d):
    return memory.power_law(memory.sign_acf(fx.event_trades(spark, d), LAGS), 2).drop("interpretation")


@query
def hurst_dfa(spark, d):
    return memory.hurst(memory.trade_series(fx.event_trades(spark, d)), "flow", F.col("ts").cast("date"))


@query
def roundtrip_kernels(spark, d):
    return memory.round_trip(memory.response(memory.bar_series(flow(spark, d)), LAGS))


@query
def roundtrip_kernels_150(spark, d):
    return memory.round_trip(memory.response(memory.bar_series(flow(spark, d)), BAR_LAGS))


@query
def memory_summary(spark, d):
    s = memory.memory_summary(fx.event_trades(spark, d), flow(spark, d), SIGN_LAGS)
    return s.select("*", "power_law.*").drop("power_law")


@query
def noarb_audit(spark, d):
    return memory.audit(memory.bar_series(flow(spark, d)), BAR_LAGS)


@query
def pit_universe(spark, d):
    from barlens.sources import archive

    return archive.universe(fx.item_trades(spark, d).select("symbol", F.col("ts").cast("date").alias("date")))


@query
def iforest_score(spark, d):
    return studies.scored(studies.book_panel(fx.quotes(spark, d), "4h"), studies.BOOK_FEATURES)[0].select("symbol", "ts", "score")


@query
def logistic_score(spark, d):
    from barlens.operators import latent

    p = studies.trade_panel(fx.item_trades(spark, d), "week")
    p = diagnostics.forward_return(p, 2).withColumn("label", w.extremity("fwd", 0.8))
    end = studies.split_time(p, 0.6)
    return latent.fit_logistic(p.where(F.col("ts") <= F.lit(end)), studies.FLOW_FEATURES).transform(p).select("symbol", "ts", "score")


@query
def run_strategy(spark, d):
    return studies.run_strategy(fx.item_trades(spark, d), "week")["stats"]


@query
def run_pipeline(spark, d):
    return studies.run_pipeline(raw_weekly(spark, d), fx.sectors(spark, d), beta_window=BETA, vol_weight_window=VOL)["deciles"]


@query
def run_backbone(spark, d):
    return studies.run_backbone(fx.item_trades(spark, d), "week")["deciles"]


@query
def run_phase1(spark, d):
    return studies.run_phase1(fx.quotes(spark, d), "4h")["verdict"]


@query
def strategy_report(spark, d):
    return studies.run_strategy(fx.item_trades(spark, d), "week")["report"]


@query
def run_propagator(spark, d):
    return studies.run_propagator(fx.event_trades(spark, d), "1h", BAR_LAGS)["audit"]


@query
def run_flow_memory(spark, d):
    s = studies.run_flow_memory(fx.event_trades(spark, d), "1h", SIGN_LAGS)["summary"]
    return s.select("*", "power_law.*").drop("power_law")


@query
def run_attribution(spark, d):
    return studies.run_attribution(fx.event_trades(spark, d), "1h")["split"]


@query
def run_metaorder(spark, d):
    return studies.run_metaorder(fx.event_trades(spark, d), "4h", 6, 0.3, 2)["universe_stats"]
