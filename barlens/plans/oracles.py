"""SQL for DuckDB over the driver's tables, one statement for each query that SQL can express."""

from __future__ import annotations

import re

# Named parts; each statement lists those it needs, in order.
PARTS = {
    "et": """SELECT user_id % 20 AS symbol, ts, event_id AS id, 100 + value AS price, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS quantity,
      event_type IN ('click', 'error') AS maker FROM events""",
    "q": """SELECT user_id % 20 AS symbol, ts, event_id AS id, CAST(100 + floor(value / 20) AS DOUBLE) - CAST(0.01 AS DOUBLE) * (1 + event_id % 2) AS pb,
      CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS qb, CAST(100 + floor(value / 20) AS DOUBLE) + CAST(0.01 AS DOUBLE) * (1 + event_id % 3) AS pa, CAST((event_id * 7) % 50 AS DOUBLE) AS qa FROM events""",
    "it": """SELECT s_nationkey AS symbol, l_shipdate AS ts, row_number() OVER (PARTITION BY s_nationkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id,
      l_extendedprice / l_quantity AS price, CAST(l_quantity AS DOUBLE) AS quantity, l_linestatus = 'O' AS maker FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    # Signed ticks with their bar, and bars of flow.
    "es": "SELECT *, CASE WHEN maker THEN -quantity ELSE quantity END AS sv, time_bucket(INTERVAL 1 hour, ts) AS bar, time_bucket(INTERVAL 4 hour, ts) AS bar4 FROM et",
    "ws": "SELECT *, CASE WHEN maker THEN -quantity ELSE quantity END AS sv, CAST(date_trunc('week', ts) AS DATE) AS bar FROM it",
    "grid": "SELECT symbol, unnest(generate_series(min(bar), max(bar), INTERVAL 1 hour)) AS ts FROM es GROUP BY 1",
    "grid4": "SELECT symbol, unnest(generate_series(min(bar4), max(bar4), INTERVAL 4 hour)) AS ts FROM es GROUP BY 1",
    "fb0": "SELECT symbol, bar AS ts, sum(sv) AS flow, arg_max(price, (ts, id)) AS close FROM es GROUP BY 1, 2",
    "fb": """SELECT g.symbol, g.ts, coalesce(flow, 0) AS flow, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS close
      FROM grid g LEFT JOIN fb0 USING (symbol, ts)""",
    "wb": """SELECT symbol, bar AS ts, arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, id)) AS close, sum(quantity) AS volume,
      sum(price * quantity) AS dollar_volume, count(*) AS n, sum(sv) / nullif(sum(quantity), 0) AS tfi FROM ws GROUP BY 1, 2""",
    "wp": "SELECT * FROM (SELECT DISTINCT ts FROM wb) CROSS JOIN (SELECT DISTINCT symbol FROM wb) LEFT JOIN wb USING (symbol, ts)",
    # Trade bars of the weekly panel: empty weeks inside a symbol's life count 0 trades.
    "tp0": """SELECT symbol, ts, tfi, dollar_volume, close, CASE WHEN ts BETWEEN min(CASE WHEN n > 0 THEN ts END) OVER (PARTITION BY symbol) AND max(CASE WHEN n > 0 THEN ts END) OVER (PARTITION BY symbol)
      THEN ln(1 + coalesce(n, 0)) END AS trade_intensity, ln(close) - lag(ln(close), 8) OVER (PARTITION BY symbol ORDER BY ts) AS trail FROM wp""",
    "tp1": "SELECT *, trail - median(trail) OVER (PARTITION BY ts) AS runup FROM tp0",
    "tp2": "SELECT *, (rank() OVER (PARTITION BY ts ORDER BY runup NULLS LAST) + (count(*) OVER (PARTITION BY ts, runup) - 1) / 2) / nullif(count(runup) OVER (PARTITION BY ts), 0) AS rr FROM tp1",
    "tp": "SELECT *, CASE WHEN runup IS NOT NULL THEN rr END - lag(CASE WHEN runup IS NOT NULL THEN rr END, 4) OVER (PARTITION BY symbol ORDER BY ts) AS runup_rank_velocity FROM tp2",
    "qe0": """SELECT *, lag(pb) OVER w AS pb0, lag(qb) OVER w AS qb0, lag(pa) OVER w AS pa0, lag(qa) OVER w AS qa0, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS gap FROM q
      WINDOW w AS (PARTITION BY symbol ORDER BY ts, id)""",
    "qe": """SELECT symbol, ts, id, CASE WHEN pb0 IS NOT NULL THEN (CASE WHEN pb >= pb0 THEN qb ELSE 0 END) - (CASE WHEN pb <= pb0 THEN qb0 ELSE 0 END)
        - (CASE WHEN pa <= pa0 THEN qa ELSE 0 END) + (CASE WHEN pa >= pa0 THEN qa0 ELSE 0 END) END AS ofi,
      (qb - qa) / nullif(qb + qa, 0) AS obi, ((qb / nullif(qb + qa, 0)) * pa + (1 - qb / nullif(qb + qa, 0)) * pb - (pa + pb) / 2) / ((pa + pb) / 2) AS microprice_adj,
      (pa - pb) / ((pa + pb) / 2) AS rel_spread, (pa + pb) / 2 AS mid, greatest(0, coalesce(gap, median(gap) OVER (PARTITION BY symbol))) AS dwell FROM qe0""",
    "f0": """SELECT wp.*, CAST(n_regionkey AS VARCHAR) AS sector, ln(close) - lag(ln(close)) OVER w AS ret, avg(close * volume) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS weight
      FROM wp JOIN nation ON n_nationkey = symbol WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "f1": """SELECT *, median(ret) OVER (PARTITION BY ts) AS market, sum(weight) OVER g - weight AS den, sum(weight * ret) OVER g - weight * ret AS num FROM f0 WINDOW g AS (PARTITION BY ts, sector)""",
    "f": "SELECT *, num / CASE WHEN den > 0 THEN den END AS sector_index FROM f1",
    "r0": "SELECT *, CASE WHEN ret IS NOT NULL AND market IS NOT NULL AND sector_index IS NOT NULL THEN 1 END AS ok FROM f",
    "r1": "SELECT *, ret * ok AS y, market * ok AS m, sector_index * ok AS s FROM r0",
    "r2": """SELECT symbol, ts, y, m, s, count(y) OVER w AS k, sum(m) OVER w AS sm, sum(s) OVER w AS ss1, sum(y) OVER w AS sy1, sum(m * m) OVER w AS mm, sum(s * s) OVER w AS ss, sum(m * s) OVER w AS ms,
      sum(m * y) OVER w AS my, sum(s * y) OVER w AS sy FROM r1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)""",
    "r3": "SELECT *, 26 + 1e-8 AS a, sm AS b, ss1 AS c, mm + 1e-8 AS d, ms AS e, ss + 1e-8 AS g, sy1 AS u, my AS v, sy AS w FROM r2 WHERE k = 26",
    "r4": "SELECT *, a * (d * g - e * e) - b * (b * g - c * e) + c * (b * e - c * d) AS det FROM r3",
    "r5": """SELECT symbol, ts, y - (u * (d * g - e * e) - b * (v * g - e * w) + c * (v * e - d * w)) / nullif(det, 0) - (a * (v * g - e * w) - u * (b * g - e * c) + c * (b * w - v * c)) / nullif(det, 0) * m
      - (a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c)) / nullif(det, 0) * s AS residual FROM r4""",
    "r": "SELECT symbol, ts, residual FROM wp LEFT JOIN r5 USING (symbol, ts)",
    "lq0": "SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS px FROM wp",
    "lq1": "SELECT *, px / lag(px) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pr FROM lq0",
    "lq": """SELECT *, CASE WHEN count(pr) OVER w >= 2 THEN stddev_pop(pr) OVER w END AS vol, sum(dollar_volume) OVER w AS adv FROM lq1
      WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""",
    "sc": """SELECT *, round(1 - close / nullif(lag(close, 4) OVER w, 0), 9) AS score, lead(close, 2) OVER w / nullif(close, 0) - 1 AS fwd,
      CAST(dense_rank() OVER (ORDER BY ts) - 1 AS INTEGER) AS t FROM lq WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "ic0": """SELECT ts, rank() OVER (PARTITION BY ts ORDER BY score) + (count(*) OVER (PARTITION BY ts, score) - 1) / 2 AS a,
      rank() OVER (PARTITION BY ts ORDER BY fwd) + (count(*) OVER (PARTITION BY ts, fwd) - 1) / 2 AS b FROM sc WHERE score IS NOT NULL AND fwd IS NOT NULL""",
    # Ranks are halves of whole numbers, so these sums are exact; a covariance of 0 that covar_pop gives as a tiny number would be a hit or not by chance.
    "ic1": """SELECT ts, CASE WHEN va > 0 AND vb > 0 THEN cov / sqrt(va) / sqrt(vb) END AS ic
      FROM (SELECT ts, sum(a * b) - m AS cov, sum(a * a) - m AS va, sum(b * b) - m AS vb FROM (SELECT *, count(*) OVER (PARTITION BY ts) * pow(count(*) OVER (PARTITION BY ts) + 1, 2) / 4 AS m FROM ic0) GROUP BY ts, m)""",
    "ic": "SELECT ts, ic FROM (SELECT DISTINCT ts FROM sc) LEFT JOIN ic1 USING (ts)",
    "l0": """SELECT *, max(t) OVER () AS last FROM sc""",
    "l1": """SELECT *, count(*) OVER (PARTITION BY t) AS nn, row_number() OVER (PARTITION BY t ORDER BY score, symbol) AS rk FROM l0
      WHERE t < last AND score IS NOT NULL AND close > 0 AND dollar_volume >= 0 AND vol IS NOT NULL AND adv > 0""",
    "l2": "SELECT *, least(greatest(1, CAST(floor(0.1 * nn) AS BIGINT)), nn // 2) AS k FROM l1 WHERE nn >= 2",
    "l3": "SELECT *, CASE WHEN rk <= k THEN 1 ELSE -1 END AS side, least(0.1, 0.125 / k) AS notional FROM l2 WHERE rk <= k OR rk > nn - k",
    "l": "SELECT symbol, side, t, ts AS entry_time, notional, last, close * (1 + side * (5 + 0.6 * vol * sqrt(notional / adv) * 1e4) / 1e4) AS ep, close AS ec FROM l3",
    "p0": """SELECT l.*, x.k AS h, sc.px, sc.vol, sc.adv, sc.ts AS at_time, sc.t AS tt FROM l, (SELECT unnest([1, 2, 3, 4]) AS k) x JOIN sc ON sc.symbol = l.symbol AND sc.t = l.t + x.k""",
    "p1": "SELECT *, min(CASE WHEN side * (px / ep - 1) <= -0.08 THEN h END) OVER (PARTITION BY symbol, t, side) AS stop_k FROM p0",
    "p": "SELECT *, coalesce(stop_k, least(4, last - t)) AS exit_k, notional / ep AS qty FROM p1",
    "tr0": """SELECT *, px * (1 - side * (5 + coalesce(0.6 * vol * sqrt(abs(qty * px) / CASE WHEN adv > 0 THEN adv END) * 1e4, 0)) / 1e4) AS xp FROM p WHERE h = exit_k""",
    "tr": """SELECT symbol, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS side, entry_time, at_time AS exit_time, h AS bars_held, ep AS entry_price, xp AS exit_price, qty * ep AS notional,
      side * qty * (xp - ep) AS pnl, side * qty * (xp - ep) / (qty * ep) AS "return", CASE WHEN stop_k IS NOT NULL THEN 'stop' WHEN exit_k >= 4 THEN 'horizon' ELSE 'final' END AS exit_reason,
      notional + qty * xp AS traded, tt FROM tr0""",
    "eq0": """SELECT tt, sum(v) AS v, sum(pnl) AS pnl FROM (SELECT tt, side * qty * (px - ep) AS v, 0 AS pnl FROM p WHERE h < exit_k UNION ALL SELECT t, side * (notional / ep) * (ec - ep), 0 FROM l
      UNION ALL SELECT tt, 0, pnl FROM tr) GROUP BY 1""",
    "eq": "SELECT ts, t, 1 + sum(coalesce(pnl, 0)) OVER (ORDER BY t) + coalesce(v, 0) AS equity FROM (SELECT DISTINCT ts, t FROM sc) LEFT JOIN eq0 ON tt = t",
    "mv0": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, ln(close) AS lp FROM fb",
    "mv": "SELECT a.symbol, a.flow, h AS lag, b.lp - a.lp AS r FROM mv0 a, (SELECT CAST(unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS INTEGER) AS h) x JOIN mv0 b ON b.symbol = a.symbol AND b.i = a.i + x.h",
    "mk0": "SELECT symbol, lag, avg(sign(flow) * r) AS mean_markout, stddev_pop(sign(flow) * r) AS std_markout, count(*) AS n_obs FROM mv WHERE flow <> 0 GROUP BY 1, 2 HAVING count(*) >= 20",
    "mk": "SELECT *, CASE WHEN std_markout > 0 THEN mean_markout / (std_markout / sqrt(n_obs)) ELSE 0 END AS t_stat, sum(mean_markout) OVER (PARTITION BY symbol ORDER BY lag) AS cumulative FROM mk0",
    "lg": "SELECT CAST(unnest(range(1, 61)) AS INTEGER) AS lag",
    "b0": "SELECT symbol, ts, flow, lp - lag(lp) OVER (PARTITION BY symbol ORDER BY ts) AS ret FROM mv0",
    "b": "SELECT *, row_number() OVER w - 1 AS i, coalesce(sum(ret) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM b0 WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts)",
    "bs": "SELECT symbol, var_pop(flow) AS v, avg(flow) AS mu FROM b GROUP BY 1",
    "rs": "SELECT a.symbol, lag, covar_pop(c.cum - a.cum, a.flow) / max(v) AS response FROM b a JOIN bs USING (symbol), lg JOIN b c ON c.symbol = a.symbol AND c.i = a.i + lag GROUP BY 1, 2 UNION ALL SELECT symbol, 0, 0 FROM bs",
    "fc": "SELECT a.symbol, lag, avg((a.flow - mu) * (c.flow - mu)) / max(v) AS acf FROM b a JOIN bs USING (symbol), lg JOIN b c ON c.symbol = a.symbol AND c.i = a.i + lag GROUP BY 1, 2 UNION ALL SELECT symbol, 0, 1 FROM bs",
    "sg": "SELECT symbol, sign(sv) AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts, id) - 1 AS i FROM es WHERE sv <> 0",
    "ss0": "SELECT symbol, avg(x) AS mu, var_pop(x) AS v, count(*) AS n FROM sg GROUP BY 1",
    "sa": """SELECT a.symbol, lag, CASE WHEN max(n) >= 62 AND max(v) >= 1e-15 THEN avg((a.x - mu) * (c.x - mu)) / max(v) ELSE 0 END AS acf FROM sg a JOIN ss0 USING (symbol), lg
      JOIN sg c ON c.symbol = a.symbol AND c.i = a.i + lag GROUP BY 1, 2 UNION ALL SELECT symbol, 0, CASE WHEN n >= 62 AND v >= 1e-15 THEN 1 ELSE 0 END FROM ss0 UNION ALL SELECT symbol, lag, 0 FROM ss0, lg WHERE lag >= n""",
    # Detrended fluctuation of each trade's flow.
    "d0": "SELECT symbol, ts, id, sv - avg(sv) OVER (PARTITION BY symbol) AS c, count(*) OVER (PARTITION BY symbol) AS n FROM es",
    "d1": "SELECT symbol, n, row_number() OVER w - 1 AS i, sum(c) OVER w AS y FROM d0 WINDOW w AS (PARTITION BY symbol ORDER BY ts, id)",
    "d2": "SELECT DISTINCT symbol, n, CAST(round_even(8 * pow(greatest(9, floor(n / 4)) / 8, k / 19), 0) AS INTEGER) AS s FROM (SELECT DISTINCT symbol, n FROM d1), (SELECT unnest(range(0, 20)) AS k)",
    "d3": """SELECT symbol, s, i // s AS box, sqrt(greatest(0, var_pop(y) - pow(covar_pop(CAST(i % s AS DOUBLE), y), 2) / var_pop(CAST(i % s AS DOUBLE)))) AS rms FROM d1 JOIN d2 USING (symbol, n)
      WHERE n // s >= 2 AND i // s < n // s GROUP BY 1, 2, 3""",
    "d4": "SELECT symbol, s, avg(rms) AS f FROM d3 GROUP BY 1, 2 HAVING avg(rms) > 0",
    "pt": """SELECT symbol, bar AS ts, sum(greatest(sv, 0)) / nullif(sum(quantity), 0) AS buy_participation, sum(greatest(-sv, 0)) / nullif(sum(quantity), 0) AS sell_participation,
      (sum(greatest(sv, 0)) - sum(greatest(-sv, 0))) / nullif(sum(quantity), 0) AS tfi, nullif(sum(quantity), 0) AS total_volume,
      CASE WHEN count(*) >= 2 AND avg(quantity) >= 1e-12 THEN stddev_pop(quantity) / avg(quantity) END AS size_cv FROM es GROUP BY 1, 2""",
    "pb": "SELECT * FROM grid LEFT JOIN pt USING (symbol, ts)",
    "g0": "SELECT symbol, bar4, greatest(0, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, id))) / 1000.0) AS g, lag(ts) OVER (PARTITION BY symbol ORDER BY ts, id) IS NOT NULL AS has FROM es",
    "g1": "SELECT symbol, bar4, CAST(g AS DOUBLE) AS g, count(*) OVER w AS n, CAST(min(g) OVER w AS DOUBLE) AS mn, CAST(max(g) OVER w AS DOUBLE) AS mx FROM g0 WHERE has WINDOW w AS (PARTITION BY symbol, bar4)",
    "g2": """SELECT *, least(n, 10) AS nb, (mx - mn) / least(n, 10) AS st, coalesce(least(CAST(floor((g - mn) / nullif(mx - mn, 0) * least(n, 10)) AS INTEGER), least(n, 10) - 1), 0) AS j0 FROM g1 WHERE n >= 3""",
    "g3": "SELECT *, CASE WHEN g < CASE WHEN j0 = nb THEN mx ELSE mn + j0 * st END THEN j0 - 1 ELSE j0 END AS j1 FROM g2",
    "g4": "SELECT *, CASE WHEN g >= CASE WHEN j1 + 1 = nb THEN mx ELSE mn + (j1 + 1) * st END AND j1 <> nb - 1 AND mx > mn THEN j1 + 1 ELSE j1 END AS j FROM g3",
    "g5": "SELECT symbol, bar4, n, j, CAST(count(*) AS DOUBLE) / n AS p FROM g4 GROUP BY 1, 2, 3, 4",
    "en": "SELECT symbol, bar4 AS ts, -sum(p * log2(p)) AS interval_entropy FROM g5 GROUP BY 1, 2",
    "pt4": """SELECT symbol, bar4 AS ts, sum(greatest(sv, 0)) / nullif(sum(quantity), 0) AS buy_participation, sum(greatest(-sv, 0)) / nullif(sum(quantity), 0) AS sell_participation,
      (sum(greatest(sv, 0)) - sum(greatest(-sv, 0))) / nullif(sum(quantity), 0) AS tfi, nullif(sum(quantity), 0) AS total_volume,
      CASE WHEN count(*) >= 2 AND avg(quantity) >= 1e-12 THEN stddev_pop(quantity) / avg(quantity) END AS size_cv FROM es GROUP BY 1, 2""",
    "pw0": "SELECT symbol, ts, coalesce(tfi, 0) AS x, coalesce(total_volume, 0) AS v, CASE WHEN abs(coalesce(tfi, 0)) >= 0.5 THEN CAST(sign(tfi) AS INTEGER) ELSE 9 END AS st FROM pb",
    "pw1": "SELECT *, CASE WHEN st = lag(st) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS nw FROM pw0",
    "pw2": "SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM pw1",
    "qb0": """SELECT symbol, time_bucket(INTERVAL {step}, ts) AS ts, sum(ofi) AS ofi, sum(obi * dwell) / nullif(sum(dwell), 0) AS obi, sum(microprice_adj * dwell) / nullif(sum(dwell), 0) AS microprice_adj,
      sum(rel_spread * dwell) / nullif(sum(dwell), 0) AS rel_spread, count(mid) AS update_intensity, arg_max(mid, (ts, id)) AS mid_close FROM qe GROUP BY 1, 2""",
}
# The reference's own ranges of lags: 500 of trades' signs, 150 of bars.
PARTS["lg500"], PARTS["lg150"] = (PARTS["lg"].replace("61", str(n + 1)) for n in (500, 150))
PARTS["sa500"] = re.sub(r"\blg\b", "lg500", PARTS["sa"].replace("62", "502"))
PARTS["rs150"], PARTS["fc150"] = (re.sub(r"\blg\b", "lg150", PARTS[x]) for x in ("rs", "fc"))


def _dfa(name: str, series: str) -> str:
    """Detrended fluctuation of a series (symbol, ts, id, x): the parts up to (symbol, h)."""
    own = [f"{name}{i}" for i in range(6)]
    PARTS[own[0]] = f"SELECT symbol, ts, id, x - avg(x) OVER (PARTITION BY symbol) AS c, count(*) OVER (PARTITION BY symbol) AS n FROM ({series})"
    for a, i in zip(own[1:5], range(1, 5), strict=True):
        PARTS[a] = re.sub(r"\bd([0-3])\b", lambda m: name + m[1], PARTS[f"d{i}"])
    PARTS[own[5]] = f"""SELECT symbol, CASE WHEN count(f) >= 4 THEN least(1.5, greatest(0, regr_slope(ln(f), ln(s)))) ELSE 0.5 END AS h
      FROM (SELECT DISTINCT symbol FROM {own[0]}) LEFT JOIN {own[4]} USING (symbol) GROUP BY 1"""
    return " ".join(own)


_DT = _dfa("dt", "SELECT symbol, ts, id, sv AS x FROM es")
_DP = _dfa("dp", "SELECT symbol, ts, 0 AS id, coalesce(lp - lag(lp) OVER (PARTITION BY symbol ORDER BY ts), 0) AS x FROM mv0")
_DR = _dfa("dr", "SELECT symbol, ts, 0 AS id, ret AS x FROM b")
_DF = _dfa("df", "SELECT symbol, ts, 0 AS id, flow AS x FROM b")
PARTS["pl"] = """SELECT symbol, count(y) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, CASE WHEN var_pop(y) > 0 THEN regr_r2(y, x) ELSE 0 END AS r2
  FROM (SELECT symbol, CASE WHEN lag >= 10 AND acf > 1e-6 THEN ln(lag) END AS x, CASE WHEN lag >= 10 AND acf > 1e-6 THEN ln(acf) END AS y FROM sa500) GROUP BY 1"""
PARTS["ms"] = """SELECT symbol, dt5.h AS hf, dp5.h AS hp, l1, l10, l100, pl.* EXCLUDE (symbol) FROM dt5 JOIN dp5 USING (symbol) JOIN pl USING (symbol)
  JOIN (SELECT symbol, max(acf) FILTER (lag = 1) AS l1, max(acf) FILTER (lag = 10) AS l10, max(acf) FILTER (lag = 100) AS l100 FROM sa500 GROUP BY 1) USING (symbol)"""
PARTS["na"] = """SELECT symbol, sum(response * acf) AS na, max(response) FILTER (lag = 50) AS plateau, max(acf) FILTER (lag = 20) AS c20, max(dr5.h) AS hp, max(df5.h) AS hf
  FROM rs150 JOIN fc150 USING (symbol, lag) JOIN dr5 USING (symbol) JOIN df5 USING (symbol) GROUP BY 1"""
PARTS["mf"] = """SELECT symbol, ts, buy_participation, sell_participation, tfi, total_volume, size_cv, interval_entropy,
  avg(CASE WHEN coalesce(abs(tfi), 0) >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS pressure_score
  FROM grid4 LEFT JOIN pt4 USING (symbol, ts) LEFT JOIN en USING (symbol, ts)"""
PARTS["mw0"], PARTS["mw1"], PARTS["mw2"] = (re.sub(r"\bpw([01])\b", r"mw\1", PARTS[x]).replace("0.5", "0.3").replace("FROM pb", "FROM mf") for x in ("pw0", "pw1", "pw2"))
PARTS["mw"] = "SELECT symbol, count(*) AS n_bars FROM mw2 WHERE st <> 9 GROUP BY symbol, run HAVING count(*) >= 2"
PARTS["qb1"] = PARTS["qb0"].replace("{step}", "1 hour")
PARTS["qb4"] = PARTS.pop("qb0").replace("{step}", "4 hour")
PARTS["qg1"] = "SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 hour)) AS ts FROM qb1 GROUP BY 1"
PARTS["qg4"] = "SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 4 hour)) AS ts FROM qb4 GROUP BY 1"
PARTS["qp"] = """SELECT symbol, ts, ofi, obi, microprice_adj, rel_spread, ln(1 + CASE WHEN there THEN coalesce(update_intensity, 0) END) AS update_intensity, mid_close
  FROM (SELECT DISTINCT ts FROM qg4) CROSS JOIN (SELECT DISTINCT symbol FROM qg4) LEFT JOIN (SELECT symbol, ts, true AS there FROM qg4) g USING (symbol, ts) LEFT JOIN qb4 USING (symbol, ts)"""


def _sql(parts: str, select: str) -> str:
    """A statement over named parts."""
    return "WITH " + ",\n".join(f"{p} AS ({PARTS[p]})" for p in parts.split()) + "\n" + select


def _r(*pairs: str) -> str:
    """Rounded columns, each given as `name` or `name=expression`."""
    out = []
    for p in pairs:
        name, _, expression = p.partition("=")
        out.append(f'round(CAST({expression or name} AS DOUBLE), 6) + 0.0 AS "{name}"')
    return ", ".join(out)


def _z(x: str) -> str:
    mean, std = f"avg({x}) OVER (PARTITION BY ts)", f"stddev_pop({x}) OVER (PARTITION BY ts)"
    return f"({x} - {mean}) / CASE WHEN {std} > abs({mean}) * 1e-12 THEN {std} END"


def _pct(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY ts, {x}) - 1) / 2) / count({x}) OVER (PARTITION BY ts) END"


_FLOW = ("tfi", "trade_intensity", "runup", "runup_rank_velocity")
_BOOK = ("ofi", "obi", "microprice_adj", "rel_spread", "update_intensity")
_WEEK, _EV, _FB = "it ws wb", "et es", "et es grid fb0 fb"
_TP, _QE = f"{_WEEK} wp tp0 tp1 tp2 tp", "q qe0 qe"
_F = f"{_WEEK} wp f0 f1 f"
_R = f"{_F} r0 r1 r2 r3 r4 r5 r"
_SC = f"{_WEEK} wp lq0 lq1 lq sc"
_L = f"{_SC} l0 l1 l2 l3 l p0 p1 p tr0 tr"
_MV = f"{_FB} mv0"
_B = f"{_MV} b0 b bs lg"
_SA = f"{_EV} sg ss0 lg sa"
_PT = f"{_EV} grid pt pb"
_EN = f"{_EV} g0 g1 g2 g3 g4 g5 en"
_IC = f"{_SC} ic0 ic1 ic"
_WIN = "least(greatest(close, quantile_cont(close, 0.1) OVER (PARTITION BY ts)), quantile_cont(close, 0.9) OVER (PARTITION BY ts))"
_EXT = "CASE WHEN close IS NOT NULL THEN CASE WHEN close >= quantile_cont(close, 0.9) OVER (PARTITION BY ts) OR close <= quantile_cont(close, 0.1) OVER (PARTITION BY ts) THEN 1 ELSE 0 END END"
_SLIP = "(5 + 0.6 * vol * sqrt(1e4 / CASE WHEN adv > 0 THEN adv END) * 1e4)"

_LAW = _r(*[f"{n}=CASE WHEN n >= 8 THEN round({x}, 3) END" for n, x in (("gamma", "-b"), ("log_amplitude", "a"), ("r_squared", "r2"), ("implied_hurst", "1 + b / 2"))])
_LAW += ", CASE WHEN n < 8 THEN 'too few positive lags for a fit' WHEN 1 + b / 2 > 0.55 THEN 'long memory' ELSE 'weak or no long memory' END AS interpretation"
_MS = f"{_MV} {_DT} {_DP} sg ss0 lg500 sa500 pl ms"
_SUMMARY = _r("hurst_flow=round(hf, 3)", "hurst_prices=round(hp, 3)", "h_gap=round(hf - hp, 3)", "sign_acf_lag1=round(l1, 4)", "sign_acf_lag10=round(l10, 4)", "sign_acf_lag100=round(l100, 4)")
_SUMMARY += f", CASE WHEN hf > hp + 0.1 THEN 'long-memory flow, diffusive prices' ELSE 'no clear gap' END AS central_tension, {_LAW}"
_NA = f"{_MV} b0 b bs lg150 rs150 fc150 {_DR} {_DF} na"
_AUDIT = _r("na_product_sum=round(na, 6)", "hurst_prices=round(hp, 3)", "hurst_flow=round(hf, 3)", "response_plateau=round(plateau, 6)", "flow_acf_lag20=round(c20, 4)")
_AUDIT += ", CASE WHEN abs(hp - 0.5) < 0.07 THEN 'prices diffusive' ELSE 'prices non-diffusive' END || ' | ' || CASE WHEN hf > 0.6 THEN 'flow long-memory' ELSE 'flow memory weak' END AS interpretation"

ORACLES: dict[str, str] = {
    "tfi_zscore_weekly": _sql(_WEEK, f"SELECT symbol, ts, {_r('tfi', 'tfi_z=' + _z('tfi'))} FROM wb"),
    "tfi_bars": _sql(f"{_EV} grid", f"""SELECT symbol, ts, {_r('tfi')}, coalesce(trade_intensity, 0) AS trade_intensity, {_r('dollar_volume', 'close')} FROM grid LEFT JOIN
      (SELECT symbol, bar AS ts, sum(sv) / nullif(sum(quantity), 0) AS tfi, count(price) AS trade_intensity, sum(price * quantity) AS dollar_volume, arg_max(price, (ts, id)) AS close FROM es GROUP BY 1, 2) USING (symbol, ts)"""),
    "ohlcv_bars": _sql(_WEEK, f"SELECT symbol, ts, {_r('open', 'high', 'low', 'close', 'volume', 'dollar_volume')}, n FROM wb"),
    "trade_panel_zscore": _sql(_TP, f"SELECT symbol, ts, {_r(*[f'{x}={_z(x)}' for x in _FLOW], 'dollar_volume', 'close')} FROM tp"),
    "trade_panel_rank": _sql(_TP, f"SELECT symbol, ts, {_r(*[f'{x}={_pct(x)}' for x in _FLOW], 'dollar_volume', 'close')} FROM tp"),
    "runup_rank_velocity": _sql(_TP, f"SELECT symbol, ts, {_r('runup', 'runup_rank_velocity', 'trade_intensity')} FROM tp"),
    "kline_geometry": _sql(_WEEK, f"""SELECT symbol, ts, {_r('illiquidity=abs(ln(close / open)) / CASE WHEN close * volume > 0 THEN close * volume END * 1e6',
      'wick=CASE WHEN high > low THEN greatest(0, least(1, (high - close) / (high - low))) END', 'upper_wick=CASE WHEN high > low THEN greatest(0, least(1, (high - greatest(open, close)) / (high - low))) END')} FROM wb"""),
    "cross_section": _sql(_WEEK, f"SELECT symbol, ts, {_r('z=' + _z('close'), 'pct_rank=' + _pct('close'), 'winsorized=' + _WIN, 'extreme=' + _EXT)} FROM wb"),
    "ofi_events": _sql(_QE, f"SELECT symbol, id, {_r('ofi')} FROM qe"),
    "book_features": _sql(_QE, f"SELECT symbol, id, {_r('obi', 'microprice_adj', 'rel_spread', 'mid')} FROM qe"),
    "ofi_bars": _sql(f"{_QE} qb1 qg1", f"SELECT symbol, ts, {_r('ofi', 'obi', 'microprice_adj', 'rel_spread')}, coalesce(update_intensity, 0) AS update_intensity, {_r('mid_close')} FROM qg1 LEFT JOIN qb1 USING (symbol, ts)"),
    "book_panel": _sql(f"{_QE} qb4 qg4 qp", f"SELECT symbol, ts, {_r(*[f'{x}={_z(x)}' for x in _BOOK], 'mid_close')} FROM qp"),
    "market_median": _sql(_F, f"SELECT DISTINCT ts, {_r('market')} FROM f"),
    "sector_loo": _sql(_F, f"SELECT symbol, ts, {_r('ret', 'sector_index')} FROM f"),
    "residuals": _sql(_R, f"SELECT symbol, ts, {_r('residual')} FROM r"),
    "rank_trajectory": _sql(_R, f"""SELECT symbol, ts, {_r('rank=x', 'rank_velocity=x - lag(x, 6) OVER (PARTITION BY symbol ORDER BY ts)')}
      FROM (SELECT symbol, ts, {_pct('residual')} AS x FROM (SELECT symbol, ts, round(residual, 9) AS residual FROM r))"""),
    "rolling_vol_adv": _sql(f"{_WEEK} wp lq0 lq1 lq", f"SELECT symbol, ts, {_r('vol', 'adv')} FROM lq"),
    "impact_costs": _sql(f"{_WEEK} wp lq0 lq1 lq", f"SELECT symbol, ts, {_r('slippage_bps=' + _SLIP, f'buy=px * (1 + {_SLIP} / 1e4)', f'sell_fill=px * (1 - coalesce({_SLIP}, 5) / 1e4)', f'round_trip_bps=2 * {_SLIP}')} FROM lq"),
    "participation": _sql(_PT, f"SELECT symbol, ts, {_r('buy_participation', 'sell_participation', 'tfi', 'total_volume', 'size_cv')} FROM pb"),
    "interval_entropy": _sql(_EN, f"SELECT symbol, ts, {_r('interval_entropy')} FROM en"),
    "metaorder_features": _sql(f"{_EN} grid4 pt4", f"""SELECT symbol, ts, {_r('buy_participation', 'sell_participation', 'tfi', 'total_volume', 'size_cv', 'interval_entropy',
      'pressure_score=avg(CASE WHEN coalesce(abs(tfi), 0) >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)')}
      FROM grid4 LEFT JOIN pt4 USING (symbol, ts) LEFT JOIN en USING (symbol, ts)"""),
    "pressure_windows": _sql(f"{_PT} pw0 pw1 pw2", f"""SELECT symbol, min(ts) AS start, max(ts) AS "end", min(st) AS direction, count(*) AS n_bars,
      {_r('avg_tfi=round(avg(abs(x)), 3)', 'max_tfi=round(max(abs(x)), 3)', 'total_volume=round(sum(v), 2)')} FROM pw2 WHERE st <> 9 GROUP BY symbol, run HAVING count(*) >= 2"""),
    "forward_return": _sql(_SC, f"SELECT symbol, ts, {_r('fwd')} FROM sc"),
    "information_coefficient": _sql(_IC, f"SELECT ts, {_r('ic')} FROM ic"),
    "ic_rolling": _sql(_IC, f"SELECT ts, {_r('ic=avg(ic) OVER (ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)')} FROM ic"),
    "ic_summary": _sql(_IC, f"SELECT {_r('ic_mean=avg(ic)', 'ic_std=stddev_pop(ic)', 'ic_ir=avg(ic) / nullif(stddev_pop(ic), 0)', 'ic_hit_rate=avg(CASE WHEN ic > 0 THEN 1 ELSE 0 END)')}, count(ic) AS n_obs FROM ic"),
    "decile_audit": _sql(_SC, f"""SELECT decile, count(*) AS "count", {_r('median=median(fwd)', 'mean=avg(fwd)', 'p5=quantile_cont(fwd, 0.05)', 'p95=quantile_cont(fwd, 0.95)', 'mean_minus_median=avg(fwd) - median(fwd)')}
      FROM (SELECT fwd, CAST(least(floor(row_number() OVER (ORDER BY score, ts, symbol) / (count(*) OVER () + 1) * 10), 9) AS INTEGER) AS decile FROM sc WHERE score IS NOT NULL AND fwd IS NOT NULL) GROUP BY 1"""),
    "lots": _sql(_L, f"SELECT symbol, side, entry_time, exit_time, bars_held, {_r('entry_price', 'exit_price', 'notional', 'pnl', 'return=tr.\"return\"')}, exit_reason FROM tr"),
    "equity": _sql(f"{_L} eq0 eq", f"SELECT ts, {_r('equity', 'ret=equity - lag(equity) OVER (ORDER BY t)')} FROM eq"),
    "bt_stats": _sql(f"{_L} eq0 eq", f"""SELECT {_r('total_return', 'ann_return=m * yr', 'sharpe=m / nullif(sd, 0) * sqrt(yr)', 'max_drawdown')}, n_trades, {_r('turnover_x_gross', 'hit_rate', 'avg_win', 'avg_loss', 'avg_bars_held', 'pct_stopped_out', 'short_pnl', 'long_pnl')}
      FROM (SELECT arg_max(equity, t) - arg_min(equity, t) AS total_return, avg(ret) AS m, stddev_samp(ret) AS sd, min(equity / peak - 1) AS max_drawdown, 365.25 * 86400 / median(step) AS yr FROM
        (SELECT *, equity - lag(equity) OVER w AS ret, max(equity) OVER w AS peak, CAST(ts - lag(ts) OVER w AS DOUBLE) * 86400 AS step FROM eq WINDOW w AS (ORDER BY t))),
      (SELECT count(*) AS n_trades, coalesce(sum(traded), 0) AS turnover_x_gross, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS hit_rate, coalesce(avg(CASE WHEN pnl > 0 THEN pnl END), 0) AS avg_win,
        coalesce(avg(CASE WHEN pnl < 0 THEN pnl END), 0) AS avg_loss, avg(bars_held) AS avg_bars_held, avg(CASE WHEN exit_reason = 'stop' THEN 1 ELSE 0 END) AS pct_stopped_out,
        coalesce(sum(CASE WHEN side = 'short' THEN pnl END), 0) AS short_pnl, coalesce(sum(CASE WHEN side = 'long' THEN pnl END), 0) AS long_pnl FROM tr)"""),
    "markout_profile": _sql(f"{_MV} mv mk0 mk", f"SELECT symbol, lag, {_r('mean_markout', 'std_markout')}, n_obs, {_r('t_stat', 'cumulative')} FROM mk"),
    "perm_transient": _sql(f"{_MV} mv mk0 mk", f"""SELECT symbol, {_r('permanent_component=round(pl, 8)', 'transient_component=round(tr, 8)')}, peak_lag, {_r('reversion_fraction=round(sh, 3)')},
      CASE WHEN sh > 0.6 THEN 'impact-dominated' WHEN sh < 0.2 THEN 'alpha-dominated' ELSE 'mixed' END AS interpretation
      FROM (SELECT *, tr / greatest(abs(pk), 1e-15) AS sh FROM (SELECT *, greatest(0, pk - pl) AS tr FROM (SELECT symbol, max(mean_markout) AS pk, arg_max(lag, (mean_markout, -lag)) AS peak_lag,
        coalesce(avg(CASE WHEN lag >= 32 THEN mean_markout END), max(mean_markout)) AS pl FROM mk GROUP BY 1)))"""),
    "adverse_selection": _sql(f"{_MV} mv", f"SELECT symbol, lag, {_r('adverse_selection=round(avg(r), 8)')} FROM mv WHERE flow > 0 GROUP BY 1, 2 HAVING count(*) >= 10"),
    "response_function": _sql(f"{_B} rs", f"SELECT symbol, lag, {_r('response')} FROM rs"),
    "flow_acf": _sql(f"{_B} fc", f"SELECT symbol, lag, {_r('acf')} FROM fc"),
    "sign_acf": _sql(_SA, f"SELECT symbol, lag, {_r('acf')} FROM sa"),
    "power_law": _sql(_SA, f"""SELECT symbol, {_r('gamma=CASE WHEN n >= 8 THEN round(-b, 3) END', 'log_amplitude=CASE WHEN n >= 8 THEN round(a, 3) END', 'r_squared=CASE WHEN n >= 8 THEN round(r2, 3) END', 'implied_hurst=CASE WHEN n >= 8 THEN round(1 + b / 2, 3) END')}
      FROM (SELECT symbol, count(y) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2 FROM (SELECT symbol, CASE WHEN lag >= 2 AND acf > 1e-6 THEN ln(lag) END AS x, CASE WHEN lag >= 2 AND acf > 1e-6 THEN ln(acf) END AS y FROM sa) GROUP BY 1)"""),
    "hurst_dfa": _sql(f"{_EV} d0 d1 d2 d3 d4", f"SELECT symbol, {_r('hurst=CASE WHEN count(*) >= 4 THEN least(1.5, greatest(0, regr_slope(ln(f), ln(s)))) ELSE 0.5 END')} FROM d4 GROUP BY 1"),
    "roundtrip_kernels": _sql(f"{_B} rs", f"""SELECT symbol, model, {_r('pnl=round(g0 * p, 8)', 'avg_buy_price=round(g0 * b, 8)', 'sell_price=round(g0 * s, 8)')} FROM (SELECT symbol, greatest(max(abs(response)), 1e-6) AS g0 FROM rs GROUP BY 1),
      (SELECT model, 20 * max(CASE WHEN t = 20 THEN price END) - sum(CASE WHEN t < 20 THEN price ELSE 0 END) AS p, avg(CASE WHEN t < 20 THEN price END) AS b, max(CASE WHEN t = 20 THEN price END) AS s
       FROM (SELECT model, t, coalesce(sum(CASE model WHEN 'permanent' THEN 1 WHEN 'slow_decay' THEN exp(-k * ln(2) / 5) ELSE CASE WHEN k = 0 THEN 1 ELSE 0 END END) FILTER (k < t), 0) AS price
         FROM (SELECT unnest(['permanent', 'slow_decay', 'purely_temporary']) AS model), (SELECT unnest(range(0, 21)) AS t), (SELECT unnest(range(0, 20)) AS k) GROUP BY 1, 2) GROUP BY 1)"""),
    "sign_acf_500": _sql(f"{_EV} sg ss0 lg500 sa500", f"SELECT symbol, lag, {_r('acf')} FROM sa500"),
    "power_law_500": _sql(f"{_EV} sg ss0 lg500 sa500 pl", f"SELECT symbol, {_LAW} FROM pl"),
    "flow_acf_150": _sql(f"{_MV} b0 b bs lg150 fc150", f"SELECT symbol, lag, {_r('acf')} FROM fc150"),
    "response_function_150": _sql(f"{_MV} b0 b bs lg150 rs150", f"SELECT symbol, lag, {_r('response')} FROM rs150"),
    "memory_summary": _sql(_MS, f"SELECT symbol, {_SUMMARY} FROM ms"),
    "run_flow_memory": _sql(f"{_MS}", f"""SELECT symbol, CASE WHEN k < 502 THEN 'too few trades for the lags' WHEN lo = hi THEN 'signs do not vary' ELSE 'ok' END AS status, {_SUMMARY}
      FROM ms JOIN (SELECT symbol, count(*) FILTER (sv <> 0) AS k, min(sign(sv)) AS lo, max(sign(sv)) AS hi FROM es GROUP BY 1) USING (symbol)"""),
    "noarb_audit": _sql(_NA, f"SELECT symbol, {_AUDIT} FROM na"),
    "run_propagator": _sql(_NA, f"SELECT symbol, 'ok' AS status, {_AUDIT} FROM na"),
    "run_metaorder": _sql(f"{_EN} grid4 pt4 mf mw0 mw1 mw2 mw", f"""SELECT symbol, n_bars, coalesce(w, 0) AS n_metaorder_windows, {_r('avg_window_bars=coalesce(round(a, 1), 0)')}, coalesce(m, 0) AS max_window_bars, {_r('mean_pressure_score=round(p, 3)', 'mean_abs_tfi=round(t, 3)', 'mean_interval_entropy=round(e, 3)')}
      FROM (SELECT symbol, count(*) AS n_bars, avg(pressure_score) AS p, avg(abs(tfi)) AS t, avg(interval_entropy) AS e FROM mf GROUP BY 1)
      LEFT JOIN (SELECT symbol, count(*) AS w, avg(n_bars) AS a, max(n_bars) AS m FROM mw GROUP BY 1) USING (symbol)"""),
    "pit_universe": """WITH f AS (SELECT DISTINCT s_nationkey AS symbol, CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
      SELECT d.date, s.symbol, f.date IS NOT NULL AS listed FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 day)) AS DATE) AS date FROM f) d CROSS JOIN (SELECT DISTINCT symbol FROM f) s
      LEFT JOIN f ON f.date = d.date AND f.symbol = s.symbol""",
}
# The study's split is the operator's, on the same bars; the kernels' largest response is that of all 150 lags.
ORACLES["run_attribution"] = ORACLES["perm_transient"]
ORACLES["roundtrip_kernels_150"] = _sql(f"{_MV} b0 b bs lg150 rs150", re.sub(r"\brs\b", "rs150", "SELECT symbol, model" + ORACLES["roundtrip_kernels"].rpartition("SELECT symbol, model")[2]))
