"""Long memory and price response: lagged moments, detrended fluctuation, power law, propagator audit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.columns import signed_volume
from barlens.functions.windows import along, numbered

#: Rows of a series that one task takes, with as many more behind them as the longest lag.
BLOCK = 8192


def lagged_sums(series: DataFrame, x: str, y: str, max_lag: int, block: int = BLOCK) -> DataFrame:
    """(symbol, lag, pairs, sx, sy, sxy) over all pairs x(i), y(i + lag) of (symbol, idx), lags 1 .. max_lag.

    Series are cut into blocks; each block gets the `max_lag` rows behind it too. Sums of blocks add up.
    """
    size = max(block, max_lag)
    b = F.expr(f"CAST(idx div {size} AS BIGINT)")
    homes = F.when((F.col("idx") % size < max_lag) & (F.col("idx") >= size), F.array(b, b - 1)).otherwise(F.array(b))
    rows = series.select("symbol", "idx", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.explode(homes).alias("home"))
    kind = dict(series.dtypes)["symbol"]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        xs, ys = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        own = int((pdf["idx"].to_numpy() < (pdf["home"].iat[0] + 1) * size).sum())
        out = []
        for lag in range(1, max_lag + 1):
            n = min(own, len(xs) - lag)
            if n <= 0:
                break
            a, c = xs[:n], ys[lag : lag + n]
            out.append((pdf["symbol"].iat[0], lag, n, a.sum(), c.sum(), float(a @ c)))
        return pd.DataFrame(out, columns=["symbol", "lag", "pairs", "sx", "sy", "sxy"])

    parts = rows.groupBy("symbol", "home").applyInPandas(sums, f"symbol {kind}, lag int, pairs bigint, sx double, sy double, sxy double")
    return parts.groupBy("symbol", "lag").agg(*[F.sum(c).alias(c) for c in ("pairs", "sx", "sy", "sxy")])


def lags(symbols: DataFrame, max_lag: int) -> DataFrame:
    return symbols.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))


def autocorrelation(series: DataFrame, x: str, max_lag: int) -> DataFrame:
    """(symbol, lag, acf), lag 0 .. max_lag: around the mean of the whole series, by the number of pairs; 0 without pairs."""
    stats = series.groupBy("symbol").agg(F.avg(x).alias("mu"), F.var_pop(x).alias("var"))
    centred = series.join(stats, "symbol").withColumn("c", F.col(x) - F.col("mu"))
    found = lagged_sums(centred, "c", "c", max_lag).join(stats, "symbol").select("symbol", "lag", (F.col("sxy") / F.col("pairs") / F.when(F.col("var") >= 1e-15, F.col("var"))).alias("acf"))
    return lags(stats, max_lag).join(found, ["symbol", "lag"], "left").withColumn("acf", F.when(F.col("lag") == 0, 1.0).otherwise(F.coalesce("acf", F.lit(0.0))))


def _day() -> Column:
    return F.col("ts").cast("date")


def trade_series(trades: DataFrame) -> DataFrame:
    """(symbol, ts, id, flow, idx, n) of all trades in order."""
    rows = trades.select("symbol", "ts", "id", signed_volume().alias("flow"))
    return numbered(rows, ["ts", "id"], _day())


def sign_acf(trades: DataFrame, max_lag: int = 500) -> DataFrame:
    """(symbol, lag, acf) of trade signs in trade order; zeros, at lag 0 too, for a short or constant series."""
    signs = trades.select("symbol", "ts", "id", F.signum(signed_volume()).alias("sign")).where("sign <> 0")
    series = numbered(signs, ["ts", "id"], _day())
    good = series.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.var_pop("sign").alias("v")).select("symbol", ((F.col("n") >= max_lag + 2) & (F.col("v") >= 1e-15)).alias("good"))
    return autocorrelation(series, "sign", max_lag).join(good, "symbol").select("symbol", "lag", F.when(F.col("good"), F.col("acf")).otherwise(0.0).alias("acf"))


def power_law(acf: DataFrame, min_lag: int = 10, max_lag: int | None = None) -> DataFrame:
    """(symbol, gamma, log_amplitude, r_squared, implied_hurst, interpretation): a line through the logarithms.

    NULL with under 8 points; r_squared is 0 where all values are equal.
    """
    upto = F.lit(True) if max_lag is None else F.col("lag") <= max_lag
    p = acf.withColumn("use", (F.col("lag") >= min_lag) & upto & (F.col("acf") > 1e-6))
    x, y = F.when(F.col("use"), F.ln("lag")), F.when(F.col("use"), F.ln(F.when(F.col("acf") > 0, F.col("acf"))))
    f = p.groupBy("symbol").agg(F.count(x).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.when(F.var_pop(y) > 0, F.regr_r2(y, x)).otherwise(0.0).alias("r"))
    enough = lambda c: F.when(F.col("n") >= 8, F.round(c, 3))
    said = F.when(F.col("n") < 8, "too few positive lags for a fit").when(1 + F.col("b") / 2 > 0.55, "long memory").otherwise("weak or no long memory")
    return f.select("symbol", enough(-F.col("b")).alias("gamma"), enough(F.col("a")).alias("log_amplitude"), enough(F.col("r")).alias("r_squared"), enough(1 + F.col("b") / 2).alias("implied_hurst"), said.alias("interpretation"))


def hurst(series: DataFrame, x: str, block: Column, min_scale: int = 8, n_scales: int = 20) -> DataFrame:
    """(symbol, hurst) by detrended fluctuation of (symbol, ts, id, x); 0.5 with under four scales.

    Up to `n_scales` scales from `min_scale` to a quarter of the series; a box's squared residual about its line
    is var(profile) - cov(t, profile)^2 / var(t).
    """
    stats = series.groupBy("symbol").agg(F.avg(x).alias("mu"))
    rows = series.join(stats, "symbol").select("symbol", "ts", "id", (F.col(x) - F.col("mu")).alias("c"), block.alias("blk"))
    p = numbered(rows, ["ts", "id"], F.col("blk"), total="c")
    top = F.greatest(F.lit(float(min_scale + 1)), F.floor(F.col("n") / 4).cast("double"))
    scales = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n_scales - 1)), lambda i: F.rint(min_scale * F.pow(top / min_scale, i / float(n_scales - 1))).cast("int")))
    q = p.select("symbol", "idx", "n", "cum", F.explode(scales).alias("s")).withColumns({"box": F.expr("idx div s"), "t": (F.col("idx") % F.col("s")).cast("double")})
    q = q.where("n div s >= 2 AND box < n div s")
    boxes = q.groupBy("symbol", "s", "box").agg(F.sqrt(F.greatest(F.lit(0.0), F.var_pop("cum") - F.covar_pop("t", "cum") ** 2 / F.var_pop("t"))).alias("rms"))
    f = boxes.groupBy("symbol", "s").agg(F.avg("rms").alias("f")).where("f > 0")
    h = f.groupBy("symbol").agg(F.count(F.lit(1)).alias("k"), F.regr_slope(F.ln("f"), F.ln("s")).alias("h"))
    h = h.select("symbol", F.when(F.col("k") >= 4, F.least(F.lit(1.5), F.greatest(F.lit(0.0), F.col("h")))).otherwise(0.5).alias("hurst"))
    return stats.select("symbol").join(h, "symbol", "left").fillna(0.5, ["hurst"])


def bar_series(bars: DataFrame) -> DataFrame:
    """(symbol, ts, id, flow, ret, idx, n, cum) of flow bars from the second on; cum: returns up to and with the bar."""
    b = bars.withColumn("lp", F.when(F.col("close") > 0, F.ln("close"))).withColumn("ret", F.col("lp") - F.lag("lp").over(along())).where("ret IS NOT NULL")
    return numbered(b.select("symbol", "ts", F.lit(0).alias("id"), "flow", "ret"), ["ts", "id"], F.trunc("ts", "month"), total="ret")


def response(series: DataFrame, max_lag: int = 150) -> DataFrame:
    """(symbol, lag, response) of a bar series: covariance of flow and the return of `lag` bars from it on, by flow's variance.

    The returns begin with the flow's own bar, and the last bar's is never used.
    """
    s = series.withColumn("before", F.col("cum") - F.col("ret"))
    # r = before(i + lag) - before(i); with flow f: sum fr = sum f(i) before(i + lag) - sum f(i) before(i) over the pairs.
    ahead = lagged_sums(s, "flow", "before", max_lag)
    n = F.col("pairs")
    var = s.groupBy("symbol").agg(F.var_pop("flow").alias("var"), F.max("n").alias("n"), F.sum(F.col("flow") * F.col("before")).alias("fb"), F.sum("before").alias("b"))
    tail = s.where(F.col("n") - F.col("idx") <= max_lag).select("symbol", (F.col("n") - F.col("idx")).cast("int").alias("lag"), F.col("flow") * F.col("before"), "before").toDF("symbol", "lag", "tfb", "tb")
    w = Window.partitionBy("symbol").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    tail = tail.select("symbol", "lag", F.sum("tfb").over(w).alias("tfb"), F.sum("tb").over(w).alias("tb"))
    j = ahead.join(var, "symbol").join(tail, ["symbol", "lag"])
    sum_fr, sum_r = F.col("sxy") - (F.col("fb") - F.col("tfb")), F.col("sy") - (F.col("b") - F.col("tb"))
    found = j.select("symbol", "lag", ((sum_fr - F.col("sx") * sum_r / n) / n / F.when(F.col("var") >= 1e-15, F.col("var"))).alias("response"))
    return lags(var, max_lag).join(found, ["symbol", "lag"], "left").fillna(0.0, ["response"])


def status(symbols: DataFrame, known: DataFrame, other: str) -> DataFrame:
    """(symbol, status) of all symbols: what is known, or else `other`."""
    return symbols.distinct().join(known, "symbol", "left").withColumn("status", F.coalesce("status", F.lit(other)))


def memory_summary(trades: DataFrame, bars: DataFrame, max_lag: int = 500) -> DataFrame:
    """One row a symbol: Hurst exponents of trades' flow and bars' returns, sign autocorrelations (NULL behind `max_lag`), the power law."""
    month = F.trunc("ts", "month")
    flow = hurst(trade_series(trades), "flow", _day()).withColumnRenamed("hurst", "hurst_flow")
    b = bars.withColumn("lp", F.when(F.col("close") > 0, F.ln("close"))).select("symbol", "ts", F.lit(0).alias("id"), F.coalesce(F.col("lp") - F.lag("lp").over(along()), F.lit(0.0)).alias("ret"))
    prices = hurst(b, "ret", month).withColumnRenamed("hurst", "hurst_prices")
    acf = sign_acf(trades, max_lag)
    at = acf.groupBy("symbol").agg(*[F.round(F.max(F.when(F.col("lag") == k, F.col("acf"))), 4).alias(f"sign_acf_lag{k}") for k in (1, 10, 100)])
    law = power_law(acf)
    out = flow.join(prices, "symbol").join(at, "symbol").join(law.select("symbol", F.struct(*law.columns[1:]).alias("power_law")), "symbol")
    said = F.when(F.col("hurst_flow") > F.col("hurst_prices") + 0.1, "long-memory flow, diffusive prices").otherwise("no clear gap")
    return out.select("symbol", F.round("hurst_flow", 3).alias("hurst_flow"), F.round("hurst_prices", 3).alias("hurst_prices"), F.round(F.col("hurst_flow") - F.col("hurst_prices"), 3).alias("h_gap"), "sign_acf_lag1", "sign_acf_lag10", "sign_acf_lag100", "power_law", said.alias("central_tension"))


def audit(series: DataFrame, max_lag: int = 150) -> DataFrame:
    """One row a symbol: sum of response x autocorrelation, Hurst exponents, plateau, autocorrelation at lag 20 (NULL behind `max_lag`), verdict."""
    r, c = response(series, max_lag), autocorrelation(series, "flow", max_lag)
    both = r.join(c, ["symbol", "lag"]).groupBy("symbol").agg(F.sum(F.col("response") * F.col("acf")).alias("na"), F.max(F.when(F.col("lag") == min(50, max_lag), F.col("response"))).alias("plateau"), F.max(F.when(F.col("lag") == 20, F.col("acf"))).alias("c20"))
    month = F.trunc("ts", "month")
    hp, hf = (hurst(series, x, month).withColumnRenamed("hurst", n) for x, n in (("ret", "hp"), ("flow", "hf")))
    j = both.join(hp, "symbol").join(hf, "symbol")
    said = F.concat_ws(" | ", F.when(F.abs(F.col("hp") - 0.5) < 0.07, "prices diffusive").otherwise("prices non-diffusive"), F.when(F.col("hf") > 0.6, "flow long-memory").otherwise("flow memory weak"))
    return j.select("symbol", F.round("na", 6).alias("na_product_sum"), F.round("hp", 3).alias("hurst_prices"), F.round("hf", 3).alias("hurst_flow"), F.round("plateau", 6).alias("response_plateau"), F.round("c20", 4).alias("flow_acf_lag20"), said.alias("interpretation"))


def round_trip(responses: DataFrame, n_clips: int = 20, clip_size: float = 1.0) -> DataFrame:
    """(symbol, model, pnl, avg_buy_price, sell_price) of buying in clips and selling at once, for three impact kernels."""
    g0 = responses.groupBy("symbol").agg(F.greatest(F.max(F.abs("response")), F.lit(1e-6)).alias("g0"))
    half = max(n_clips // 4, 1)
    steps = np.arange(n_clips)
    kernels = {"permanent": np.ones(n_clips), "slow_decay": np.exp(-steps * np.log(2) / half), "purely_temporary": (steps == 0).astype(float)}
    rows = []
    for name, k in kernels.items():
        price = np.concatenate([[0.0], np.cumsum(k)]) * clip_size  # before the clip, with n clips bought
        rows.append((name, float(n_clips * clip_size * price[n_clips] - clip_size * price[:n_clips].sum()), float(price[:n_clips].mean()), float(price[n_clips])))
    table = responses.sparkSession.createDataFrame(rows, "model string, p double, b double, s double")
    j = g0.crossJoin(F.broadcast(table))
    return j.select("symbol", "model", *[F.round(F.col(c) * F.col("g0"), 8).alias(n) for c, n in (("p", "pnl"), ("b", "avg_buy_price"), ("s", "sell_price"))])


