"""Queries of the window indicators over hourly bars, with SQL twins."""

from __future__ import annotations

from tickloom.operators import indicators as I
from tickloom.plans.common import HOURLY_SQL, Registry, hourly
from tickloom.sources.domain import QUOTES_SQL, quotes

R = Registry()
_KEYS = ("instrument", "ts")


def _add(name: str, make, columns: list[str], ready: int | None, exprs: dict[str, str], steps: str = "", source: str = "bars") -> None:
    """``exprs``: SQL of each column over the last step's rows, window w being the series; ``ready``: rows of the warm-up."""
    cols = [*_KEYS, *columns, *(["ready"] if ready is not None else [])]
    sel = ", ".join(f"round({e}, 6) AS {c}" if not e.startswith("=") else f"{e[1:]} AS {c}" for c, e in exprs.items())
    flag = f", row_number() OVER w >= {ready} AS ready" if ready is not None else ""
    sql = f"WITH {HOURLY_SQL}{steps} SELECT instrument, ts, {sel}{flag} FROM {source} WINDOW w AS (PARTITION BY instrument ORDER BY ts)"
    R.add(name, lambda s, d: make(hourly(s, d)).select(*cols), sql)


def rows(n: int) -> str:
    """The window of the last n rows."""
    return f"(PARTITION BY instrument ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


ALL = "(PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def weighted(x: str, weights: list[float]) -> str:
    n = len(weights)
    lags = [(x if k == 0 else f"lag({x}, {k}) OVER w", weights[n - 1 - k]) for k in range(n)]
    return "(" + " + ".join(f"coalesce({v} * {w}, 0)" for v, w in lags) + ") / (" + " + ".join(f"CASE WHEN {v} IS NULL THEN 0 ELSE {w} END" for v, w in lags) + ")"


def ramp(n: int) -> list[float]:
    return [float(i + 1) for i in range(n)]


W = "WINDOW w AS (PARTITION BY instrument ORDER BY ts)"
_add("ind_sma_10", lambda b: I.sma(b, 10), ["sma"], 10, {"sma": f"avg(close) OVER {rows(10)}"})
_add("ind_wma_4", lambda b: I.wma(b, [0.1, 0.2, 0.3, 0.4]), ["wma"], 4, {"wma": weighted("close", [0.1, 0.2, 0.3, 0.4])})
_add("ind_hma_9", lambda b: I.hma(b, 9), ["hma"], 9, {"hma": weighted("x", ramp(3))}, f", h AS (SELECT instrument, ts, 2 * {weighted('close', ramp(4))} - {weighted('close', ramp(9))} AS x FROM bars {W})", "h")
_add("ind_vwap", I.vwap, ["vwap"], None, {"vwap": "CASE WHEN v > 0 THEN pv / v ELSE p END"}, """, d AS (SELECT instrument, ts, (high + low + close) / 3 AS tp, volume, ts // 86400000000000 AS day FROM bars),
x AS (SELECT instrument, ts, sum(tp * volume) OVER dw AS pv, sum(volume) OVER dw AS v, first_value(tp) OVER dw AS p FROM d WINDOW dw AS (PARTITION BY instrument, day ORDER BY ts ROWS UNBOUNDED PRECEDING))""", "x")  # fmt: skip
_full = lambda e: f"CASE WHEN i >= 10 THEN {e} END"
_add("ind_linear_regression_10", lambda b: I.linear_regression(b, 10), ["slope", "intercept", "value", "degree", "cfo", "r2"], 10,
     {"slope": _full("s"), "intercept": _full("m - s * 5.5"), "value": _full("m + s * 4.5"), "degree": _full("degrees(atan(s))"), "cfo": _full("100 * (m + s * 4.5 - close) / close"), "r2": _full("r")},
     f""", n AS (SELECT *, row_number() OVER {ALL} AS i FROM bars), g AS (SELECT instrument, ts, close, i, regr_slope(close, i) OVER {rows(10)} AS s, regr_r2(close, i) OVER {rows(10)} AS r, avg(close) OVER {rows(10)} AS m FROM n)""", "g")
_add("ind_efficiency_ratio_10", lambda b: I.efficiency_ratio(b, 10), ["er"], 10, {"er": f"CASE WHEN sum(d) OVER {rows(10)} > 0 THEN abs(close - first_value(close) OVER {rows(10)}) / sum(d) OVER {rows(10)} ELSE 0 END"}, f", x AS (SELECT *, abs(close - lag(close) OVER w) AS d FROM bars {W})", "x")
_add("ind_roc_10", lambda b: I.roc(b, 10), ["roc"], 10, {"roc": f"(close - first_value(close) OVER {rows(10)}) / first_value(close) OVER {rows(10)}"})
_add("ind_roc_log_10", lambda b: I.roc(b, 10, log=True), ["roc"], 10, {"roc": f"ln(close / first_value(close) OVER {rows(10)})"})
_add("ind_stochastics_14_3", lambda b: I.stochastics(b, 14, 3), ["k", "d"], 14,
     {"k": f"coalesce(last_value(k IGNORE NULLS) OVER {ALL}, 0)", "d": f"coalesce(last_value(dd IGNORE NULLS) OVER {ALL}, 0)"},
     f""", x AS (SELECT instrument, ts, close - min(low) OVER {rows(14)} AS up, max(high) OVER {rows(14)} - min(low) OVER {rows(14)} AS rg FROM bars),
y AS (SELECT instrument, ts, CASE WHEN rg > 0 THEN 100 * up / rg END AS k, CASE WHEN rg > 0 THEN 100 * sum(up) OVER z / sum(rg) OVER z END AS dd FROM x WINDOW z AS (PARTITION BY instrument, rg > 0 ORDER BY ts ROWS 2 PRECEDING))""", "y")  # fmt: skip
_add("ind_cci_14", lambda b: I.cci(b, 14), ["cci"], 14, {"cci": f"coalesce(last_value(v IGNORE NULLS) OVER {ALL}, 0)"},
     f""", x AS (SELECT instrument, ts, (high + low + close) / 3 AS tp FROM bars), y AS (SELECT instrument, ts, tp, avg(tp) OVER {rows(14)} AS m, list(tp) OVER {rows(14)} AS l FROM x),
z AS (SELECT instrument, ts, tp - m AS up, list_sum(list_transform(l, lambda e: abs(e - m))) / len(l) AS mad FROM y), q AS (SELECT instrument, ts, CASE WHEN mad > 1e-12 THEN up / (0.015 * mad) END AS v FROM z)""", "q")  # fmt: skip
_add("ind_macd_sma_12_26", lambda b: I.macd_sma(b, 12, 26), ["macd"], 26, {"macd": f"avg(close) OVER {rows(12)} - avg(close) OVER {rows(26)}"})
_add("ind_bollinger_20_2", lambda b: I.bollinger(b, 20, 2.0), ["middle", "upper", "lower"], 20,
     {"middle": f"avg(tp) OVER {rows(20)}", "upper": f"avg(tp) OVER {rows(20)} + 2 * stddev_pop(tp) OVER {rows(20)}", "lower": f"avg(tp) OVER {rows(20)} - 2 * stddev_pop(tp) OVER {rows(20)}"}, ", x AS (SELECT instrument, ts, (high + low + close) / 3 AS tp FROM bars)", "x")
_add("ind_aroon_14", lambda b: I.aroon(b, 14), ["up", "down", "aroon"], 15, {"up": "100 * (1 - (i - h) / 14)", "down": "100 * (1 - (i - l) / 14)", "aroon": "100 * (1 - (i - h) / 14) - 100 * (1 - (i - l) / 14)"},
     f""", n AS (SELECT *, row_number() OVER {ALL} AS i FROM bars), x AS (SELECT instrument, ts, i, CAST(list_max(list_transform(list({{'v': high, 'i': i}}) OVER {rows(15)}, lambda e: e)).i AS DOUBLE) AS h,
CAST(list_max(list_transform(list({{'v': -low, 'i': i}}) OVER {rows(15)}, lambda e: e)).i AS DOUBLE) AS l FROM n)""", "x")  # fmt: skip
_add("ind_amat_5_10_3", lambda b: I.amat(b, 5, 10, 3), ["long_run", "short_run"], 13,
     {"long_run": "=(live AND df > 1e-12 AND abs(ds) >= 1e-12)", "short_run": "=(live AND df < -1e-12 AND abs(ds) >= 1e-12)"},
     f""", x AS (SELECT instrument, ts, avg(close) OVER {rows(5)} AS f, avg(close) OVER {rows(10)} AS s, row_number() OVER {ALL} >= 10 AS live FROM bars),
y AS (SELECT instrument, ts, live, f - first_value(f) OVER z AS df, s - first_value(s) OVER z AS ds FROM x WINDOW z AS (PARTITION BY instrument, live ORDER BY ts ROWS 3 PRECEDING))""", "y")  # fmt: skip
_add("ind_bias_10", lambda b: I.bias(b, 10), ["bias"], 10, {"bias": f"close / avg(close) OVER {rows(10)} - 1"})
_add("ind_vhf_14", lambda b: I.vhf(b, 14), ["vhf"], 14, {"vhf": f"CASE WHEN row_number() OVER w > 14 THEN (max(close) OVER {rows(14)} - min(close) OVER {rows(14)}) / 14 / avg(d) OVER {rows(14)} ELSE 0 END"}, f", x AS (SELECT *, abs(close - coalesce(lag(close) OVER w, close)) AS d FROM bars {W})", "x")
_add("ind_kvo_5_10_4", lambda b: I.kvo(b, 5, 10, 4), ["kvo"], 13, {"kvo": "CASE WHEN live THEN k ELSE 0 END"},
     f""", t AS (SELECT instrument, ts, volume, (high + low + close) / 3 AS tp FROM bars), p AS (SELECT *, coalesce(lag(tp) OVER w, 0) AS pv FROM t {W}),
s AS (SELECT instrument, ts, CASE WHEN tp > pv THEN volume WHEN tp < pv THEN -volume ELSE 0 END AS sv FROM p), x AS (SELECT instrument, ts, avg(sv) OVER {rows(5)} - avg(sv) OVER {rows(10)} AS x, row_number() OVER {ALL} >= 10 AS live FROM s),
y AS (SELECT instrument, ts, live, avg(x) OVER (PARTITION BY instrument, live ORDER BY ts ROWS 3 PRECEDING) AS k FROM x)""", "y")  # fmt: skip
_signed = ", x AS (SELECT instrument, ts, CASE WHEN close > open THEN volume WHEN close < open THEN -volume ELSE 0 END AS s FROM bars)"
_add("ind_obv", I.obv, ["obv"], 1, {"obv": f"sum(s) OVER {ALL}"}, _signed, "x")
_add("ind_obv_10", lambda b: I.obv(b, 10), ["obv"], 10, {"obv": f"sum(s) OVER {rows(10)}"}, _signed, "x")
_TR = f", x AS (SELECT *, greatest(coalesce(lag(close) OVER w, close), high) - least(low, coalesce(lag(close) OVER w, close)) AS tr FROM bars {W})"
_add("ind_atr_10", lambda b: I.atr(b, 10), ["atr"], 10, {"atr": f"greatest(avg(tr) OVER {rows(10)}, 0)"}, _TR, "x")
_add("ind_pressure_sma_10", lambda b: I.pressure_sma(b, 10), ["pressure", "cumulative"], 10, {"pressure": "p", "cumulative": f"sum(p) OVER {ALL}"},
     _TR + f", y AS (SELECT instrument, ts, CASE WHEN avg(volume) OVER {rows(10)} = 0 OR avg(tr) OVER {rows(10)} = 0 THEN 0 ELSE ((close - low) - (high - close)) / avg(tr) OVER {rows(10)} * volume / avg(volume) OVER {rows(10)} END AS p FROM x)", "y")
_add("ind_psychological_line_10", lambda b: I.psychological_line(b, 10), ["psl"], 10, {"psl": f"100 * avg(u) OVER {rows(10)}"}, f", x AS (SELECT *, CASE WHEN close > lag(close) OVER w THEN 1.0 ELSE 0.0 END AS u FROM bars {W})", "x")
_add("ind_donchian_20", lambda b: I.donchian(b, 20), ["upper", "lower", "middle"], 20, {"upper": f"max(high) OVER {rows(20)}", "lower": f"min(low) OVER {rows(20)}", "middle": f"(max(high) OVER {rows(20)} + min(low) OVER {rows(20)}) / 2"})
_add("ind_keltner_10_2", lambda b: I.keltner(b, 10, 2.0), ["middle", "upper", "lower", "position"], 10, {"middle": "m", "upper": "m + 2 * a", "lower": "m - 2 * a", "position": "CASE WHEN a > 0 THEN (close - m) / (2 * a) ELSE 0 END"},
     _TR + f", y AS (SELECT instrument, ts, close, avg((high + low + close) / 3) OVER {rows(10)} AS m, avg(tr) OVER {rows(10)} AS a FROM x)", "y")
_add("ind_volatility_ratio_5_20", lambda b: I.volatility_ratio(b, 5, 20), ["vr"], 20, {"vr": f"coalesce(last_value(v IGNORE NULLS) OVER {ALL}, 0)"},
     _TR + f", y AS (SELECT instrument, ts, CASE WHEN avg(tr) OVER {rows(5)} > 0 THEN avg(tr) OVER {rows(20)} / avg(tr) OVER {rows(5)} END AS v FROM x)", "y")
_add("ind_rvi_10", lambda b: I.rvi(b, 10), ["rvi"], 10, {"rvi": f"CASE WHEN avg(u) OVER {rows(10)} + avg(d) OVER {rows(10)} > 0 THEN 100 * avg(u) OVER {rows(10)} / (avg(u) OVER {rows(10)} + avg(d) OVER {rows(10)}) ELSE 0 END"},
     f""", x AS (SELECT instrument, ts, close, coalesce(lag(close) OVER w, close) AS p, coalesce(stddev_samp(close) OVER {rows(10)}, 0) AS sd FROM bars {W}),
y AS (SELECT instrument, ts, CASE WHEN close > p THEN sd ELSE 0 END AS u, CASE WHEN close < p THEN sd ELSE 0 END AS d FROM x)""", "y")  # fmt: skip
_lad = lambda c, cuts: "CASE WHEN " + c + " = 0 THEN 0 " + " ".join(f"WHEN {c} <= avg({c}) OVER {rows(10)} + ({t}) * stddev_pop({c}) OVER {rows(10)} + 1e-12 THEN {i + 1}" for i, t in enumerate(cuts)) + f" ELSE {len(cuts) + 1} END"
_add("ind_fuzzy_candles_10", lambda b: I.fuzzy_candles(b, 10), ["direction", "size", "body", "upper_wick", "lower_wick"], 10,
     {"direction": "=CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END", "size": "=" + _lad("len", [-1.0, 0.5, 1.0, 2.0, 3.0]), "body": "=" + _lad("bd", [-0.5, 0.5, 1.0]), "upper_wick": "=" + _lad("uw", [-0.5, 0.5, 1.0]), "lower_wick": "=" + _lad("lw", [-0.5, 0.5, 1.0])},
     """, l AS (SELECT *, abs(high - low) AS len FROM bars), x AS (SELECT *, CASE WHEN len = 0 THEN 0 ELSE abs(open - close) / len END AS bd, CASE WHEN len = 0 THEN 0 ELSE (high - greatest(open, close)) / len END AS uw, CASE WHEN len = 0 THEN 0 ELSE (least(open, close) - low) / len END AS lw FROM l)""", "x")  # fmt: skip
_add("ind_swings_10", lambda b: I.swings(b, 10), ["direction", "changed", "high_price", "low_price", "since_high", "since_low", "length", "duration"], None,
     {"direction": "=dir", "changed": "=coalesce(flag = -prev, false)", "high_price": "hp", "low_price": "lp", "since_high": "=sh", "since_low": "=sl", "length": "CASE WHEN was THEN hp - lp ELSE 0 END", "duration": "=CASE WHEN was THEN CASE WHEN dir = 1 THEN sl ELSE sh END ELSE 0 END"},
     f""", a AS (SELECT *, row_number() OVER {ALL} AS i, high >= max(high) OVER {rows(10)} AND low >= min(low) OVER {rows(10)} AS h, low <= min(low) OVER {rows(10)} AND high <= max(high) OVER {rows(10)} AS l FROM bars),
b AS (SELECT *, CASE WHEN h AND NOT l THEN 1 WHEN l AND NOT h THEN -1 END AS flag FROM a),
c AS (SELECT instrument, ts, flag, i, coalesce(last_value(flag IGNORE NULLS) OVER {ALL}, 0) AS dir, last_value(flag IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
coalesce(last_value(CASE WHEN flag = 1 THEN high END IGNORE NULLS) OVER {ALL}, 0) AS hp, coalesce(last_value(CASE WHEN flag = -1 THEN low END IGNORE NULLS) OVER {ALL}, 0) AS lp,
i - coalesce(last_value(CASE WHEN flag = 1 THEN i END IGNORE NULLS) OVER {ALL}, 0) AS sh, i - coalesce(last_value(CASE WHEN flag = -1 THEN i END IGNORE NULLS) OVER {ALL}, 0) AS sl FROM b),
d AS (SELECT *, coalesce(lag(hp <> 0 AND lp <> 0) OVER {ALL}, false) AS was FROM c)""", "d")  # fmt: skip
R.add(
    "ind_spread_analyzer_20",
    lambda s, d: I.spread_analyzer(quotes(s, d), 20).select("instrument", "seq", "spread", "mean_spread", "ready"),
    f"WITH {QUOTES_SQL} SELECT instrument, seq, round(ask - bid, 6) AS spread, round(avg(ask - bid) OVER z, 6) AS mean_spread, row_number() OVER w >= 20 AS ready FROM quotes WINDOW w AS (PARTITION BY instrument ORDER BY ts, seq), z AS (PARTITION BY instrument ORDER BY ts, seq ROWS 19 PRECEDING)",
)
R.add(
    "ind_book_imbalance",
    lambda s, d: I.book_imbalance(quotes(s, d)).select("instrument", "seq", "imbalance"),
    f"WITH {QUOTES_SQL} SELECT instrument, seq, round(CASE WHEN bid_size > 0 AND ask_size > 0 THEN least(bid_size, ask_size) / greatest(bid_size, ask_size) ELSE 0 END, 6) AS imbalance FROM quotes",
)
