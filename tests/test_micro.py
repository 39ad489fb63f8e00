"""Hand-computed cases, error contracts, and twins of the relational plans."""

import datetime as dt
import hashlib
import io
import urllib.parse
import zipfile

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barlens import catalog
from barlens.functions import columns as c
from barlens.functions import windows as w
from barlens.operators import attribution, bars, book, diagnostics, latent, memory, metaorder, residual
from barlens.operators.backtest import Backtest
from barlens.operators.impact import Impact
from barlens.plans import studies
from barlens.sources import archive
from barlens.sources import fixtures as fx
from barlens.streaming import bars as stream_bars

T0 = dt.datetime(2024, 1, 1)


def ticks(spark, rows):
    """(seconds, price, quantity, maker) of one symbol."""
    data = [(1, T0 + dt.timedelta(seconds=s), i, float(p), float(q), m) for i, (s, p, q, m) in enumerate(rows)]
    return spark.createDataFrame(data, "symbol int, ts timestamp_ntz, id long, price double, quantity double, is_buyer_maker boolean")


def values(df, column, *order):
    return [r[column] for r in df.orderBy(*order).collect()]


def test_book_features(spark):
    q = [(1, T0 + dt.timedelta(seconds=i), i, *map(float, x)) for i, x in enumerate([(100, 10, 101, 5), (100, 12, 101, 5), (101, 3, 102, 4), (100, 7, 101, 6)])]
    df = spark.createDataFrame(q, "symbol int, ts timestamp_ntz, id long, best_bid_price double, best_bid_qty double, best_ask_price double, best_ask_qty double")
    assert values(book.event_features(df), "ofi", "id") == [None, 2, 8, -9]
    one = spark.createDataFrame([(99.0, 3.0, 101.0, 1.0)], "best_bid_price double, best_bid_qty double, best_ask_price double, best_ask_qty double")
    r = one.select(c.imbalance(), c.microprice_adjustment(), c.relative_spread()).first()
    assert r == pytest.approx((0.5, 0.005, 0.02))


def test_dwell_weights(spark):
    rows = [(1, T0 + dt.timedelta(seconds=s), i, None, float(o), 0.0, 0.0, 1.0) for i, (s, o) in enumerate([(0, 1), (10, 0), (40, -1)])]
    ev = spark.createDataFrame(rows, "symbol int, ts timestamp_ntz, id long, ofi double, obi double, microprice_adj double, rel_spread double, mid double")
    assert values(book.quote_bars(ev, "1min"), "obi", "ts") == pytest.approx([-1 / 6])


def test_trade_bars_fill_gaps_inside_life(spark):
    b = bars.trade_bars(ticks(spark, [(0, 10, 3, False), (1, 11, 1, True), (130, 12, 2, False)]), "1min")
    assert values(b, "tfi", "ts") == [0.5, None, 1.0]
    assert values(b, "trade_intensity", "ts") == [2, 0, 1]
    assert values(b, "close", "ts") == [11, None, 12]
    with pytest.raises(ValueError):
        bars.bar("7min")


def test_metaorder_micro(spark):
    p = metaorder.participation(ticks(spark, [(0, 1, 1, False), (1, 1, 2, False), (2, 1, 3, True), (61, 1, 5, False)]), "1min")
    assert values(p, "size_cv", "ts") == [pytest.approx(0.4082483), None]
    e = metaorder.interval_entropy(ticks(spark, [(s, 1, 1, False) for s in (0, 1, 2, 4, 8)]), "1min")
    assert values(e, "interval_entropy", "ts") == pytest.approx([1.5])
    e = metaorder.interval_entropy(ticks(spark, [(s, 1, 1, False) for s in (0, 1, 2, 3)]), "1min")
    assert values(e, "interval_entropy", "ts") == [0]


def test_entropy_bins_equal_numpy(spark):
    rng = np.random.default_rng(3)
    at = np.cumsum(rng.integers(1, 60, 400))
    e = metaorder.interval_entropy(ticks(spark, [(int(s), 1, 1, False) for s in at]), "1h")
    gaps, bar = np.diff(at) * 1000.0, at[1:] // 3600
    for r in e.collect():
        own = gaps[bar == int((r["ts"] - T0).total_seconds() // 3600)]
        n = np.histogram(own, bins=min(10, len(own)))[0]
        p = n[n > 0] / n.sum()
        assert r["interval_entropy"] == pytest.approx(-(p * np.log2(p)).sum())


def test_pressure_runs(spark):
    rows = [(1, T0 + dt.timedelta(hours=i), t, 1.0) for i, t in enumerate([0.7, 0.8, 0.9, 0.7, -0.7, 0.8])]
    found = metaorder.pressure_windows(spark.createDataFrame(rows, "symbol int, ts timestamp_ntz, tfi double, total_volume double")).collect()
    assert [(r["direction"], r["n_bars"], r["avg_tfi"], r["max_tfi"]) for r in found] == [(1, 4, 0.775, 0.9)]


def panel(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_cross_section(spark):
    df = panel(spark, [(i, 1, x) for i, x in enumerate([1.0, 2.0, 2.0, None])], "symbol int, ts int, x double")
    assert values(df.select("symbol", w.percentile_rank("x").alias("r")), "r", "symbol") == [pytest.approx(1 / 3), pytest.approx(5 / 6), pytest.approx(5 / 6), None]
    df = panel(spark, [(i, 1, float(x)) for i, x in enumerate([1, 2, 3])] + [(i, 2, 5.0) for i in range(3)], "symbol int, ts int, x double")
    assert values(df.select("symbol", "ts", w.zscore("x").alias("z")), "z", "ts", "symbol") == [pytest.approx(-1.2247449), 0, pytest.approx(1.2247449), None, None, None]
    with pytest.raises(ValueError):
        w.normalized(df, ["x"], "other")


def test_candles(spark):
    r = panel(spark, [(10.0, 14.0, 8.0, 9.0, 2.0)], "open double, high double, low double, close double, volume double").select(c.wick(), c.upper_wick()).first()
    assert r == pytest.approx((5 / 6, 4 / 6))
    r = panel(spark, [(5.0, 5.0, 5.0, 5.0, 0.0)], "open double, high double, low double, close double, volume double").select(c.wick(), c.illiquidity()).first()
    assert tuple(r) == (None, None)


def test_bool_and_signed_volume(spark):
    df = panel(spark, [("true", "3"), (" False", "2"), ("1", "x"), ("no idea", "1"), ("t", "1"), ("yes", "1"), ("0", "NaN"), (None, "1")], "m string, q string").select(c.to_bool("m").alias("b"), c.signed_volume("q", "m").alias("v")).collect()
    assert [r["b"] for r in df] == [True, False, True, None, None, None, False, None]
    assert [r["v"] for r in df] == [-3, 2, 0, None, None, None, 0, None]
    for kind, values_ in (("double", (1.0, 0.0, 2.0, float("nan"))), ("int", (1, 0, 2, None)), ("boolean", (True, False, True, None))):
        got = panel(spark, [(i, x) for i, x in enumerate(values_)], f"i int, m {kind}").select("i", c.to_bool("m").alias("b"), c.signed_volume(F.lit(3), "m").alias("v"))
        assert values(got, "b", "i") == [True, False, True, None] and values(got, "v", "i") == [-3, 3, -3, None]


def test_bad_quantities_are_rejected(spark):
    t = ticks(spark, [(0, 10, 3, False), (1, 11, float("nan"), True), (2, 12, 1, True)])
    r = bars.trade_bars(t, "1min").first()
    assert (r["tfi"], r["trade_intensity"], r["dollar_volume"], r["close"]) == (0.5, 2, 42, 12)
    text = t.withColumn("quantity", F.when(F.col("id") == 1, "none").otherwise(F.col("quantity").cast("string")))
    assert bars.trade_bars(text, "1min").first() == r and bars.ohlcv_bars(text, "1min").first()["volume"] == 4
    maker = t.withColumn("is_buyer_maker", F.when(F.col("id") == 2, 1.0).when(F.col("id") == 0, 0.0))
    assert bars.trade_bars(maker, "1min").first()["tfi"] == 0.5


def test_neighbours_over_hours_equal_one_window(spark):
    rng = np.random.default_rng(4)
    at = np.cumsum(rng.choice([1, 700, 3599, 3601, 9000], 300))
    rows = [(i % 2, T0 + dt.timedelta(seconds=int(s)), i, float(rng.normal()) if i % 7 else None) for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "symbol int, ts timestamp_ntz, id long, x double").repartition(5)
    own = Window.partitionBy("symbol").orderBy("ts", "id")
    names = ["id", "prev_x", "prev_ts", "next_ts"]
    want = df.select("id", F.lag("x").over(own), F.lag("ts").over(own), F.lead("ts").over(own)).toDF(*names)
    got = w.neighbours(df, ["x", "ts"], ["ts"])
    assert got.columns == [*df.columns, *names[1:]]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.collect()))


def test_impact(spark):
    i = Impact()
    df = panel(spark, [(1e4, 1e6, 0.02), (1e4, 0.0, 0.02)], "n double, a double, v double")
    r = df.select(i.slippage_bps("n", "a", "v").alias("s"), i.execute(F.lit(1), F.lit(100.0), "n", "a", "v").alias("e"), i.round_trip_bps("n", "a", "v").alias("t"), i.fill(F.lit(1), F.lit(100.0), "n", "a", "v").alias("f")).collect()
    assert tuple(r[0])[:3] == pytest.approx((17, 100.17, 34))
    assert r[1]["s"] is None and r[1]["f"] == pytest.approx(100.05)


def test_rolling_fit_equals_numpy(spark):
    rng = np.random.default_rng(1)
    n, length = 60, 12
    y, m, s = rng.normal(size=(3, n)) * 0.01
    rows = [(1, i, float(y[i]), float(m[i]), None if i == 20 else float(s[i])) for i in range(n)]
    got = values(residual.residuals(panel(spark, rows, "symbol int, ts int, ret double, market double, sector_index double"), length), "residual", "ts")
    for i in range(n):
        lo = i - length + 1
        if lo < 0 or lo <= 20 <= i:
            assert got[i] is None
            continue
        x = np.stack([np.ones(length), m[lo : i + 1], s[lo : i + 1]], axis=1)
        b = np.linalg.solve(x.T @ x + 1e-8 * np.eye(3), x.T @ y[lo : i + 1])
        assert got[i] == pytest.approx(y[i] - b @ x[-1], abs=1e-10)


def test_missing_sector_is_an_error(spark):
    p = panel(spark, [(1, 1, 1.0, 1.0)], "symbol int, ts int, close double, volume double")
    with pytest.raises(Exception, match="sector"):
        residual.factors(p, panel(spark, [(2, "x")], "symbol int, sector string")).collect()


def bar_loop(score, close, dv, b: Backtest):
    """The simulation bar by bar, on arrays of bars x symbols."""
    n, m = score.shape
    px = close.copy()
    for t in range(1, n):
        px[t] = np.where(np.isnan(px[t]), px[t - 1], px[t])
    ret = np.full((n, m), np.nan)
    ret[1:] = px[1:] / px[:-1] - 1
    i = b.impact

    def before(x, t, k, s):
        part = x[max(0, t - k) : t, s]
        return part[~np.isnan(part)]

    def vol(t, s):
        v = before(ret, t, i.vol_lookback, s)
        return v.std() if len(v) >= 2 else np.nan

    def adv(t, s):
        v = before(dv, t, i.adv_lookback, s)
        return v.sum() if len(v) else np.nan

    def fill(side, p, notional, t, s):
        a, v = adv(t, s), vol(t, s)
        bps = i.base_fee_bps + (i.gamma * v * np.sqrt(abs(notional) / a) * 1e4 if a > 0 and not np.isnan(v) else 0)
        return p * (1 + side * bps / 1e4)

    book, out, realized, equity = [], [], 0.0, []
    for t in range(n):
        stay = []
        for side, s, t0, entry, qty in book:
            p, held = px[t, s], t - t0
            reason = "stop" if side * (p / entry - 1) <= -b.stop_loss else "horizon" if held >= b.holding_bars else "final" if t == n - 1 else None
            if not reason:
                stay.append((side, s, t0, entry, qty))
                continue
            x = fill(-side, p, qty * p, t, s)
            realized += side * qty * (x - entry)
            out.append((s, side, t0, t, reason, round(side * qty * (x - entry), 12)))
        book = stay
        if t % b.rebalance_every == 0 and t < n - 1:
            ok = [s for s in range(m) if not np.isnan(score[t, s]) and close[t, s] > 0 and dv[t, s] >= b.min_dollar_volume and not np.isnan(vol(t, s)) and adv(t, s) > 0]
            if len(ok) >= 2:
                ok.sort(key=lambda s: (score[t, s], s))
                k = min(max(1, int(b.quantile * len(ok))), len(ok) // 2)
                size = min(b.max_weight * b.gross_exposure, b.gross_exposure / max(1, -(-b.holding_bars // b.rebalance_every)) / 2 / k)
                for side, s in [(-1, s) for s in ok[-k:]] + [(1, s) for s in ok[:k]]:
                    e = fill(side, close[t, s], size, t, s)
                    book.append((side, s, t, e, size / e))
        equity.append(b.gross_exposure + realized + sum(side * q * (px[t, s] - e) for side, s, _, e, q in book))
    return sorted(out), equity


@pytest.mark.parametrize("seed", [1, 2])
def test_lots_equal_bar_loop(spark, seed):
    rng = np.random.default_rng(seed)
    n, m = 24, 6
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.05, (n, m)), axis=0))
    close[rng.random((n, m)) < 0.1] = np.nan
    score, dv = rng.normal(size=(n, m)), rng.uniform(1, 5, (n, m))
    b = Backtest(holding_bars=5, quantile=0.3, rebalance_every=2)
    none = lambda v: None if np.isnan(v) else float(v)
    rows = [(s, T0 + dt.timedelta(hours=t), none(score[t, s]), none(close[t, s]), float(dv[t, s])) for t in range(n) for s in range(m)]
    got = b.run(spark.createDataFrame(rows, "symbol int, ts timestamp_ntz, score double, close double, dollar_volume double"))
    hour = lambda x: int((x - T0).total_seconds() // 3600)
    own = sorted((r["symbol"], 1 if r["side"] == "long" else -1, hour(r["entry_time"]), hour(r["exit_time"]), r["exit_reason"], round(r["pnl"], 12)) for r in got["trades"].collect())
    lots, equity = bar_loop(score, close, dv, b)
    assert own == lots
    assert values(got["equity"], "equity", "ts") == pytest.approx(equity, abs=1e-12)
    assert got["stats"].first()["n_trades"] == len(lots)


def test_backtest_parameters():
    for bad in ({"quantile": 0.6}, {"holding_bars": 0}, {"stop_loss": 0.0}):
        with pytest.raises(ValueError):
            Backtest(**bad)


def test_diagnostics(spark):
    p = panel(spark, [(i, 1, float(s), float(f)) for i, (s, f) in enumerate([(1, 3), (2, 1), (3, 2)])], "symbol int, ts int, score double, fwd double")
    assert values(diagnostics.information_coefficient(p), "ic", "ts") == pytest.approx([-0.5])
    ic = panel(spark, [(1, 1.0), (2, None), (3, -1.0), (4, 1.0)], "ts int, ic double")
    assert diagnostics.ic_summary(ic).first()["ic_hit_rate"] == 0.5
    p = panel(spark, [(i, 1, float(i), 0.0) for i in range(5)], "symbol int, ts int, score double, fwd double")
    assert values(diagnostics.decile_audit(p), "decile", "decile") == [1, 3, 5, 6, 8]
    with pytest.raises(ValueError):
        diagnostics.forward_return(p, 0)


def test_lagged_sums_over_blocks(spark):
    x = np.random.default_rng(5).normal(size=101)
    df = panel(spark, [("a", i, float(v)) for i, v in enumerate(x)], "symbol string, idx long, x double")
    got = {r["lag"]: r for r in memory.lagged_sums(df, "x", "x", 9, block=16).collect()}
    for lag in range(1, 10):
        assert got[lag]["pairs"] == 101 - lag
        assert got[lag]["sxy"] == pytest.approx(float(x[:-lag] @ x[lag:]))


def test_rank_correlation_of_zero_is_no_hit(spark):
    order = [(1.0, 2.0), (2.0, 4.0), (3.0, 1.0), (4.0, 3.0)]
    rows = [(T0 + dt.timedelta(days=d), s, f + d) for d in range(40) for s, f in order]
    p = spark.createDataFrame(rows, "ts timestamp_ntz, score double, fwd double").repartition(7)
    r = diagnostics.ic_summary(diagnostics.information_coefficient(p)).first()
    assert (r["ic_mean"], r["ic_std"], r["ic_ir"], r["ic_hit_rate"], r["n_obs"]) == (0, 0, None, 0, 40)


def test_memory_micro(spark):
    s = panel(spark, [("a", i, float((-1) ** i)) for i in range(4)], "symbol string, idx long, x double")
    assert values(memory.autocorrelation(s, "x", 2), "acf", "lag") == pytest.approx([1, -1, 1])
    acf = panel(spark, [("a", k, 1.0 if k == 0 else k**-0.4) for k in range(100)], "symbol string, lag int, acf double")
    assert tuple(memory.power_law(acf).first())[1:] == (0.4, 0.0, 1.0, 0.8, "long memory")
    r = {x["model"]: x["pnl"] for x in memory.round_trip(panel(spark, [("a", 1, 2.0)], "symbol string, lag int, response double")).collect()}
    assert r["permanent"] == 420 and r["purely_temporary"] == 2


def lagged(x, y, n):
    """Covariance of x(i) and y(i + lag) about x's mean and y's, by the number of pairs; 0 at lag 0."""
    return np.array([0.0] + [float(np.mean((x[:-k] - x[:-k].mean()) * (y[k:] - y[:-k] - (y[k:] - y[:-k]).mean()))) for k in range(1, n + 1)])


def test_registered_memory_queries_have_all_lags(spark, tmp_path):
    rng = np.random.default_rng(11)
    n = 900
    sign = np.sign(np.convolve(rng.normal(size=n + 200), np.arange(1, 202) ** -0.7, "valid")[:n])
    value, k = rng.integers(1, 100, n), rng.integers(1, 50, n)
    rows = [(i, T0 + dt.timedelta(minutes=20 * i), 20, "error" if sign[i] < 0 else "view", float(value[i]), '{"k": %d}' % k[i]) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    q = {name: catalog.QUERIES[name](spark, str(tmp_path)) for name in ("sign_acf_500", "power_law_500", "memory_summary", "flow_acf_150", "response_function_150", "noarb_audit")}

    s = sign - sign.mean()
    acf = np.array([1.0] + [float(s[:-j] @ s[j:]) / (n - j) / sign.var() for j in range(1, 501)])
    assert values(q["sign_acf_500"], "acf", "lag") == pytest.approx(acf, abs=1e-6)
    use = np.array([j for j in range(10, 501) if acf[j] > 1e-6])
    slope = np.polyfit(np.log(use), np.log(acf[use]), 1)[0]
    m = q["memory_summary"].first()
    assert [m[f"sign_acf_lag{j}"] for j in (1, 10, 100)] == pytest.approx(acf[[1, 10, 100]], abs=6e-5)
    assert m["gamma"] == q["power_law_500"].first()["gamma"] == pytest.approx(-slope, abs=6e-4)

    bar = np.arange(n) // 3
    flow, close = np.bincount(bar, sign * k)[1:], np.log(100.0 + value[2::3])
    before, f = np.cumsum(np.r_[0, np.diff(close)])[:-1], flow - flow.mean()
    fc = np.array([1.0] + [float(f[:-j] @ f[j:]) / (len(f) - j) / flow.var() for j in range(1, 151)])
    r = lagged(flow, before, 150) / flow.var()
    assert values(q["flow_acf_150"], "acf", "lag") == pytest.approx(fc, abs=1e-6)
    assert values(q["response_function_150"], "response", "lag") == pytest.approx(r, abs=1e-6)
    assert q["noarb_audit"].first()["na_product_sum"] == pytest.approx(float(r @ fc), abs=2e-6)


def test_no_other_lag_under_a_lags_name(spark):
    t = ticks(spark, [(600 * i, 10 + i % 7, 1 + i % 3, i % 5 < 2) for i in range(80)])
    b = bars.flow_bars(t, "1h")
    m = memory.memory_summary(t, b, 15).first()
    assert m["sign_acf_lag10"] is not None and m["sign_acf_lag100"] is None
    assert memory.audit(memory.bar_series(b), 9).first()["flow_acf_lag20"] is None


def test_dfa_equals_numpy(spark):
    y = np.random.default_rng(8).normal(size=500)
    df = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), i, float(v)) for i, v in enumerate(y)], "symbol string, ts timestamp_ntz, id long, x double")
    got = memory.hurst(df, "x", F.col("ts").cast("date")).first()["hurst"]
    prof, f, used = np.cumsum(y - y.mean()), [], []
    for s in np.unique(np.rint(np.geomspace(8, 125, 20)).astype(int)):
        k = len(y) // s
        boxes = prof[: k * s].reshape(k, s)
        t = np.arange(s)
        f.append(np.mean([np.sqrt(np.mean((b - np.polyval(np.polyfit(t, b, 1), t)) ** 2)) for b in boxes]))
        used.append(s)
    assert got == pytest.approx(np.polyfit(np.log(used), np.log(f), 1)[0], abs=1e-6)


def test_markout_guards(spark):
    b = panel(spark, [(1, i, 1.0, 100.0 + i) for i in range(15)], "symbol int, ts int, flow double, close double")
    assert attribution.markout(b, (1,)).count() == 0
    assert attribution.adverse_selection(b, (1,)).count() == 1
    assert attribution.permanent_transient(attribution.markout(b, (1,))).count() == 0


def test_forest_samples_rows_not_values(spark, monkeypatch):
    seen = []
    grow = latent.grow
    monkeypatch.setattr(latent, "grow", lambda x, *a: seen.append(x) or grow(x, *a))
    for value in range(3):
        rows = [(1, T0 + dt.timedelta(hours=i), float(value) if i % 3 == 0 else 10 + i / 7) for i in range(3000)]
        latent.fit_forest(spark.createDataFrame(rows, "symbol int, ts timestamp_ntz, a double"), ["a"], trees=10, rows=30)
    for x in seen:
        assert len(x) == 300 and 0.2 < (x == x.min()).mean() < 0.47


def test_forest_finds_outliers(spark):
    rng = np.random.default_rng(2)
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(1, 1000, 9.0, -9.0), (1, 1001, None, None), (1, 1002, None, 0.0)]
    df = panel(spark, rows, "symbol int, ts int, a double, b double")
    scores = {r["ts"]: r["score"] for r in latent.fit_forest(df, ["a", "b"], trees=50).transform(df).collect()}
    assert scores[1001] is None and scores[1002] is not None
    assert scores[1000] == max(v for v in scores.values() if v is not None)
    with pytest.raises(ValueError):
        latent.fit_forest(df.where("ts < 0"), ["a"])


def zipped(text):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", text)
    return buf.getvalue()


TRADES = "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n"


def test_logistic_equals_newton(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2)) * [1, 20] + [0, 5]
    y = (x[:, 0] - x[:, 1] / 20 + rng.normal(size=300) > 0.8).astype(int)
    rows = [(i, float(a), float(b) if i % 11 else None, float(v) if i % 13 else None) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))]
    df = panel(spark, [*rows, (999, None, None, 1.0)], "ts int, a double, b double, label double")
    scores = {r["ts"]: r["score"] for r in latent.fit(df, ["b", "a"], "logistic").transform(df).collect()}
    # Imputed and scaled over all rows with a feature, then Newton's method with balanced weights and the same penalty.
    full = np.array([[r[1], np.nan if r[2] is None else r[2]] for r in rows])
    full = np.where(np.isnan(full), np.nanmedian(full, axis=0), full)
    z = np.column_stack([(full - full.mean(axis=0)) / full.std(axis=0), np.ones(300)])
    known = np.array([r[3] is not None for r in rows])
    t, u = z[known], np.array([r[3] for r in rows if r[3] is not None])
    weight = np.where(u == 1, len(u) / 2 / u.sum(), len(u) / 2 / (len(u) - u.sum()))
    v, keep = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-t @ v))
        v -= np.linalg.solve((t * (weight * p * (1 - p))[:, None]).T @ t + keep, t.T @ (weight * (p - u)) + keep @ v)
    want = 1 / (1 + np.exp(-z @ v))
    assert scores[999] is None
    assert [scores[i] for i in range(300)] == pytest.approx(want, abs=2e-4)
    with pytest.raises(ValueError):
        latent.fit(df.where("label IS NULL"), ["a"], "logistic")
    with pytest.raises(ValueError):
        latent.fit(df, ["a"], "other")


def test_ordered_rank_equals_one_window(spark):
    rng = np.random.default_rng(12)
    score = np.where(rng.random(800) < 0.4, 1.5, rng.normal(size=800).round(1))
    rows = [(int(s), T0 + dt.timedelta(days=int(d)), float(x)) for s, d, x in zip(rng.integers(0, 9, 800), rng.integers(0, 200, 800), score, strict=True)]
    df = spark.createDataFrame([*{(s, t): (s, t, x) for s, t, x in rows}.values()], "symbol int, ts timestamp_ntz, score double").repartition(6)
    want = df.withColumn("w", F.row_number().over(Window.orderBy("score", "ts", "symbol")))
    got = diagnostics.ordered_rank(df, 20).join(want, ["symbol", "ts", "score"])
    assert got.count() == df.count() and got.where("r <> w").count() == 0 and got.where(F.col("n") != df.count()).count() == 0
    with pytest.raises(ValueError):
        diagnostics.decile_audit(panel(spark, [], "symbol int, ts int, score double, fwd double"))


def test_verdicts(spark):
    table = lambda mean, median: panel(spark, [(0, 5.0, 5.0), (9, mean, median)], "decile int, mean double, median double")
    said = lambda *x: diagnostics.audit_verdict(table(*x)).first()["verdict"].split(":")[0]
    assert [said(1.0, -1.0), said(-1.0, 1.0), said(3.0, 1.0), said(1.1, 1.0)] == ["tail-made", "tail-lost", "skewed", "broad"]


def test_split_of_bars(spark):
    p = panel(spark, [(s, t) for s in range(3) for t in range(20)], "symbol int, ts int")
    assert [studies.split_time(p, 0.6), studies.split_time(p, 0.6, 5), studies.split_time(p, 1.0), studies.split_time(p, 0.1, 9)] == [12, 7, 19, 0]
    with pytest.raises(ValueError):
        studies.split_time(p.where("ts < 9"), 0.6)


DIR = "/root/testdata/sf0.001"


def test_strategy_trades_after_training_only(spark, tmp_path):
    got = studies.run_strategy(fx.item_trades(spark, DIR), "week", backtest=Backtest(holding_bars=3))
    p = got["panel"].toPandas()
    times = sorted(p["ts"].unique())
    end = times[int(len(times) * 0.6)]
    lots, stats = got["trades"].toPandas(), got["stats"].first()
    assert len(lots) == stats["n_trades"] > 0 and lots["entry_time"].min() > end and p["score"].dropna().between(0, 1).all()
    assert lots["pnl"].sum() == pytest.approx(stats["short_pnl"] + stats["long_pnl"], abs=1e-9)
    # The same book by the bar loop.
    part = p[p["ts"] > end]
    wide = [part.pivot(index="ts", columns="symbol", values=c).sort_index() for c in ("score", "close", "dollar_volume")]
    want, equity = bar_loop(*[x.to_numpy(float) for x in wide], Backtest(holding_bars=3))
    assert len(want) == len(lots) and lots["pnl"].sum() == pytest.approx(sum(x[5] for x in want), abs=1e-9)
    assert values(got["equity"], "equity", "ts") == pytest.approx(equity, abs=1e-9)
    report = got["report"].orderBy("place").collect()
    assert [r["name"] for r in report] == [*studies.REPORTED] and report[4]["value"] == stats["n_trades"]
    assert {r["name"]: r["note"] for r in report}["short_pnl"] == (None if stats["short_pnl"] > 0 else "the short side doesn't pay")
    studies.write(got["trades"], f"file://{tmp_path}/lots", "symbol")
    assert spark.read.parquet(f"file://{tmp_path}/lots").count() == len(lots)


def test_pipeline_diagnoses_later_rows(spark):
    klines = bars.ohlcv_bars(fx.item_trades(spark, DIR), "week")
    got = studies.run_pipeline(klines, fx.sectors(spark, DIR), beta_window=10, vol_weight_window=8)
    assert got["scores"].where("score NOT BETWEEN 0 AND 1").count() == 0
    d = got["deciles"].collect()
    assert len(d) == 10 and max(r["count"] for r in d) - min(r["count"] for r in d) <= 2
    times = sorted(r["ts"] for r in klines.select("ts").distinct().collect())
    assert got["ic"].first()["n_obs"] <= len(times) - int(len(times) * 0.6) - 7
    a, b = got["ic"].first(), got["ic_flipped"].first()
    assert (a["ic_mean"], a["ic_ir"], a["ic_hit_rate"]) == (-b["ic_mean"], -b["ic_ir"], b["ic_hit_rate"])
    assert got["verdict"].first()["decile"] == 9
    with pytest.raises(ValueError):
        studies.run_pipeline(klines.drop("low"), fx.sectors(spark, DIR))


def test_studies_of_panels(spark):
    a = studies.run_backbone(fx.item_trades(spark, DIR), "week", runup_window=6, velocity_window=3, normalize="rank")
    b = studies.run_phase1(fx.quotes(spark, DIR), "4h", normalize=None)
    for got in (a, b):
        assert got["ic"].first()["n_obs"] > 0 and got["deciles"].count() == 10 and got["panel"].where("score IS NOT NULL").count() > 0
    with pytest.raises(ValueError):
        studies.run_backbone(fx.item_trades(spark, DIR), "week", normalize="other")


def test_studies_of_flow_give_a_status(spark):
    # One symbol trades to and fro, one buys in equal lots, one has a single bar.
    rows = [(s, T0 + dt.timedelta(minutes=10 * i), i, 10.0 + i % 3, 1.0 + (i % 5 if s == "a" else 0), s == "a" and i % 7 < 3) for s in "ab" for i in range(81)]
    t = spark.createDataFrame([*rows, ("c", T0, 0, 5.0, 1.0, True)], "symbol string, ts timestamp_ntz, id long, price double, quantity double, is_buyer_maker boolean")
    p = studies.run_propagator(t, "15min", 12, 5)
    state = {r["symbol"]: (r["status"], r["na_product_sum"] is None) for r in p["audit"].collect()}
    assert state["a"] == ("ok", False) and state["c"] == ("fewer than two bars", True)
    b = studies.run_propagator(t.where("symbol <> 'a'"), "30min", 5)
    assert {r["symbol"]: r["status"] for r in b["audit"].collect()} == {"b": "flow does not vary", "c": "fewer than two bars"}
    assert b["response"].count() == b["flow_acf"].count() == b["round_trip"].count() == 0
    m = {r["symbol"]: r["status"] for r in studies.run_flow_memory(t, "15min", 30)["summary"].collect()}
    assert m == {"a": "ok", "b": "signs do not vary", "c": "too few trades for the lags"}
    x = studies.run_attribution(t, "15min", (1, 2))
    assert x["markout"].where("symbol = 'a'").count() == 2 and x["split"].where("symbol = 'a'").count() == 1
    w_ = studies.run_metaorder(t, "30min", 3, 0.9, 2)
    r = {r["symbol"]: r for r in w_["universe_stats"].collect()}
    assert r["b"]["n_metaorder_windows"] == 1 and r["b"]["max_window_bars"] == r["b"]["n_bars"] == 27 and r["b"]["mean_abs_tfi"] == 1


def test_archive(spark, tmp_path):
    folder = tmp_path / archive.prefix("aggTrades", "AAA")
    folder.mkdir(parents=True)
    # Milliseconds with a header, and microseconds without one.
    texts = {"2024-01-01": TRADES + "1,10.5,2,1,1,1704067200000,true\n", "2024-01-03": "2,11,1,2,2,1704240000000000,False\n3,,x,2,2,1704240000000001,1\n"}
    for day, text in texts.items():
        (folder / f"AAA-aggTrades-{day}.zip").write_bytes(zipped(text))
    root = f"file://{tmp_path}"
    df = archive.load_trades(spark, root, "AAA", "2024-01-01", "2024-01-31").orderBy("id").collect()
    assert [(r["symbol"], r["price"], r["quantity"], r["is_buyer_maker"], r["ts"].isoformat()) for r in df] == [
        ("AAA", 10.5, 2, True, "2024-01-01T00:00:00"), ("AAA", 11.0, 1, False, "2024-01-03T00:00:00"), ("AAA", None, None, True, "2024-01-03T00:00:00.000001"),
    ]
    assert archive.load(spark, root, "aggTrades", ["AAA", "none"], "2025-01-01", "2025-01-31").columns == archive.load(spark, root, "aggTrades", "AAA", "2024-01-01", "2024-01-01").columns
    assert archive.load(spark, root, "aggTrades", "none", "2024-01-01", "2024-01-31").count() == 0
    assert [r["listed"] for r in archive.universe(archive.catalog(spark, root, "aggTrades")).orderBy("date").collect()] == [True, False, True]
    # A good digest, a wrong one, and a damaged file that isn't asked for.
    digest = hashlib.sha256((folder / "AAA-aggTrades-2024-01-01.zip").read_bytes()).hexdigest()
    (folder / "AAA-aggTrades-2024-01-01.zip.CHECKSUM").write_text(f"{digest.upper()}  x.zip")
    (folder / "AAA-aggTrades-2024-01-03.zip.CHECKSUM").write_text("0" * 64 + "  x.zip")
    (folder / "AAA-aggTrades-2024-01-02.zip").write_bytes(b"no zip")
    assert archive.load_trades(spark, root, "AAA", "2024-01-01", "2024-01-01").count() == 1
    with pytest.raises(Exception, match="published digest"):
        archive.load_trades(spark, root, "AAA", "2024-01-03", "2024-01-03").collect()
    assert archive.load_trades(spark, root, "AAA", "2024-01-03", "2024-01-03", verify=False).count() == 2
    assert sorted(r["ok"] for r in archive.checked(spark, root, "aggTrades").collect()) == [False, True, True]


def test_archive_opens_wanted_files_only(spark, tmp_path):
    for s in ("AAA", "BBB"):
        folder = tmp_path / archive.prefix("aggTrades", s)
        folder.mkdir(parents=True)
        (folder / f"{s}-aggTrades-2024-01-01.zip").write_bytes(zipped("1,1,1,1,1,1704067200000,true\n"))
    df = archive.load_trades(spark, f"file://{tmp_path}", "AAA", "2024-01-01", "2024-01-01")
    (tmp_path / archive.prefix("aggTrades", "BBB") / "BBB-aggTrades-2024-01-01.zip").unlink()
    assert [r["symbol"] for r in df.collect()] == ["AAA"]


def test_quotes_by_transaction_time(spark, tmp_path):
    folder = tmp_path / archive.prefix("bookTicker", "AAA")
    folder.mkdir(parents=True)
    (folder / "AAA-bookTicker-2024-01-01.zip").write_bytes(zipped("7,10,1,11,2,1704067200000,1704067260000\n"))
    r = archive.load_quotes(spark, f"file://{tmp_path}", "AAA", "2024-01-01", "2024-01-01").first()
    assert (r["id"], r["ts"].isoformat(), r["best_bid_price"], r["best_ask_qty"]) == (7, "2024-01-01T00:00:00", 10, 2)


def test_remote_archive(spark, tmp_path):
    good, key = zipped(TRADES + "1,10.5,2,1,1,1704067200000,true\n"), lambda s, d: archive.prefix("aggTrades", s) + f"{s}-aggTrades-{d}.zip"
    blobs = {f"http://files/{key(s, d)}": good for s, d in (("AAA", "2024-01-01"), ("AAA", "2024-01-03"), ("BBB", "2024-01-02"))}
    blobs |= {f"http://files/{key('AAA', '2024-01-01')}.CHECKSUM": hashlib.sha256(good).hexdigest().encode()}
    tag = lambda kind, inner, x: f"<{kind}><{inner}>{x}</{inner}></{kind}>"

    def get(url):
        if not url.startswith("http://lists"):
            if url not in blobs:
                raise FileNotFoundError(url)
            return blobs[url]
        where = urllib.parse.parse_qs(urllib.parse.urlparse(url).query)["prefix"][0]
        names = sorted({x.removeprefix("http://files/") for x in blobs} | {where + "readme.zip"})
        inner = [tag("Contents", "Key", x) for x in names if x.startswith(where) and "/" not in x[len(where) :]]
        inner += [tag("CommonPrefixes", "Prefix", x) for x in sorted({where + x[len(where) :].split("/")[0] + "/" for x in names if x.startswith(where) and "/" in x[len(where) :]})]
        return f"<R xmlns='x'>{''.join(inner)}</R>".encode()

    a = archive.Archive("http://files", "http://lists", get=get)
    assert a.symbols("aggTrades") == ["AAA", "BBB"] and a.dates("aggTrades", "AAA") == [dt.date(2024, 1, 1), dt.date(2024, 1, 3)]
    there = archive.universe(a.files(spark, "aggTrades"))
    assert there.count() == 6 and there.where("listed").count() == 3
    assert len(a.mirror(tmp_path, "aggTrades", ["AAA", "BBB"], "2024-01-01", "2024-01-03")) == 3
    assert archive.load_trades(spark, f"file://{tmp_path}", ["AAA", "BBB"], "2024-01-01", "2024-01-03").groupBy("symbol").count().orderBy("symbol").collect() == [("AAA", 2), ("BBB", 1)]


def test_fetch_tries_again(monkeypatch):
    import urllib.error

    asked = []

    def gone(url, timeout):
        asked.append(url)
        raise urllib.error.HTTPError(url, 404, "", {}, None)

    monkeypatch.setattr(archive.urllib.request, "urlopen", gone)
    with pytest.raises(FileNotFoundError):
        archive.fetch("http://x", wait=0)
    assert len(asked) == 1
    answers = iter([OSError("reset"), urllib.error.HTTPError("u", 503, "", {}, None), io.BytesIO(b"ok")])

    def flaky(url, timeout):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    monkeypatch.setattr(archive.urllib.request, "urlopen", flaky)
    assert archive.fetch("http://x", wait=0) == b"ok"
    answers = iter([OSError("reset")] * 4)
    with pytest.raises(OSError):
        archive.fetch("http://x", wait=0)


def test_archive_listing_and_download(tmp_path):
    page = "<R xmlns='x'><IsTruncated>{}</IsTruncated><Contents><Key>{}</Key><Size>5</Size></Contents><CommonPrefixes><Prefix>p/</Prefix></CommonPrefixes></R>"
    pages = iter([page.format("true", "a"), page.format("false", "b")])
    assert archive.list_prefix("http://x", "p", lambda url: next(pages).encode()) == ({"a": 5, "b": 5}, ["p/", "p/"])
    with pytest.raises(ValueError):
        archive.parse_listing("no page")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("x.csv", "1")

    def get(url):
        if url.endswith(".CHECKSUM"):
            raise FileNotFoundError(url)
        return buf.getvalue()

    assert archive.download("http://x/a.zip", tmp_path / "d/a.zip", get).read_bytes() == buf.getvalue()
    with pytest.raises(ValueError, match="checksum"):
        archive.download("http://x/b.zip", tmp_path / "b.zip", lambda url: b"0" * 64 if url.endswith("SUM") else buf.getvalue())


def test_epoch_units(spark):
    times = [1_700_000_000_000, 1_700_000_000_000_000, 1_700_000_000_000_000_000]
    df = panel(spark, [(x, archive.unit_of([x, None, "bad"])) for x in times], "x long, u string").select(archive.epoch("x", "u").alias("t"))
    assert {r["t"].isoformat() for r in df.collect()} == {"2023-11-14T22:13:20"}
    assert archive.unit_of([]) == "ms"


def test_stream_bars_equal_batch(spark, tmp_path):
    df = ticks(spark, [(0, 10, 3, False), (30, 11, 1, True), (70, 12, 2, False)]).withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_bars.trade_bars(stream, "1min", "0 seconds").writeStream.outputMode("complete").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    got = values(spark.table("bars"), "tfi", "ts")
    assert got == values(bars.trade_bars(df, "1min", fill=False), "tfi", "ts") == [0.5, 1.0]
