"""Queries of the recurrences; their SQL twins are recursive queries, a row number at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import folds as O
from tickloom.plans.common import HOURLY_SQL, Registry, hourly
from tickloom.sources import domain

R = Registry()


def recursive(first: dict[str, str], then: dict[str, str], out: dict[str, str], columns: str = "close") -> str:
    """State names to SQL over x (this row) and r (the state before); ``out``: columns over r."""
    cols = ", ".join(first)
    return f"""WITH RECURSIVE {HOURLY_SQL}, x AS (SELECT instrument, ts, {columns}, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS i FROM bars),
r(instrument, ts, i, {cols}) AS (SELECT x.instrument, x.ts, x.i, {', '.join(f'CAST({e} AS DOUBLE)' for e in first.values())} FROM x WHERE i = 1
UNION ALL SELECT x.instrument, x.ts, x.i, {', '.join(then[c] for c in first)} FROM r JOIN x ON x.instrument = r.instrument AND x.i = r.i + 1)
SELECT instrument, ts, {', '.join(f'{e} AS {c}' for c, e in out.items())} FROM r"""


def _add(name, make, inputs, outputs, sql):
    R.add(name, lambda s, d: O.fold(hourly(s, d), make, ["instrument"], ["ts"], inputs, outputs), sql)


def _ema(name: str, x: str, a: float) -> str:
    return f"{a!r} * ({x}) + (1 - {a!r}) * r.{name}"


A10, A5, A12, A26 = 2 / 11, 2 / 6, 2 / 13, 2 / 27
UP, DOWN = "greatest(x.close - r.p, 0)", "greatest(r.p - x.close, 0)"
_add("fold_ema_10", lambda: O.Ema(10), ["close"], "ema double, ready boolean", recursive({"v": "x.close"}, {"v": _ema("v", "x.close", A10)}, {"ema": "round(v, 6)", "ready": "i >= 10"}))
_add("fold_wilder_10", lambda: O.Ema(10, True), ["close"], "rma double, ready boolean", recursive({"v": "x.close"}, {"v": _ema("v", "x.close", 0.1)}, {"rma": "round(v, 6)", "ready": "i >= 10"}))
_add("fold_dema_10", lambda: O.Dema(10), ["close"], "dema double, ready boolean", recursive({"a": "x.close", "b": "x.close"}, {"a": _ema("a", "x.close", A10), "b": _ema("b", _ema("a", "x.close", A10), A10)}, {"dema": "round(2 * a - b, 6)", "ready": "i >= 10"}))
_add("fold_macd_ema_12_26", lambda: O.Macd(12, 26), ["close"], "macd double, ready boolean", recursive({"a": "x.close", "b": "x.close"}, {"a": _ema("a", "x.close", A12), "b": _ema("b", "x.close", A26)}, {"macd": "round(a - b, 6)", "ready": "i >= 26"}))
_add("fold_rsi_10", lambda: O.Rsi(10), ["close"], "rsi double, ready boolean",
     recursive({"p": "x.close", "u": "0", "d": "0"}, {"p": "x.close", "u": _ema("u", UP, A10), "d": _ema("d", DOWN, A10)}, {"rsi": "round(CASE WHEN d = 0 THEN 1 ELSE 1 - 1 / (1 + u / d) END, 6)", "ready": "i >= 10"}))
_add("fold_cmo_10", lambda: O.Cmo(10), ["close"], "cmo double, ready boolean",
     recursive({"p": "x.close", "u": "0", "d": "0"}, {"p": "x.close", "u": _ema("u", UP, 0.1), "d": _ema("d", DOWN, 0.1)}, {"cmo": "round(CASE WHEN i < 10 OR u + d = 0 THEN 0 ELSE 100 * (u - d) / (u + d) END, 6)", "ready": "i >= 10"}))
_ROWS10 = "(PARTITION BY instrument ORDER BY ts ROWS 9 PRECEDING)"
_W = "(PARTITION BY instrument ORDER BY ts)"
_CMO = f"""(SELECT instrument, ts, close, row_number() OVER {_W} AS n, avg(greatest(dd, 0)) OVER {_ROWS10} AS g, avg(greatest(-dd, 0)) OVER {_ROWS10} AS l
FROM (SELECT *, close - coalesce(lag(close) OVER {_W}, close) AS dd FROM bars))"""
_add("fold_vidya_10", lambda: O.Vidya(10), ["close"], "vidya double, ready boolean",
     recursive({"v": "0"}, {"v": f"CASE WHEN x.i > 10 THEN {A10!r} * x.k * x.close + (1 - {A10!r} * x.k) * r.v ELSE 0 END"}, {"vidya": "round(v, 6)", "ready": "i >= 10"}, "close, k").replace("FROM bars),\nr(", f"FROM (SELECT *, CASE WHEN g + l = 0 THEN 0 ELSE abs((g - l) / (g + l)) END AS k FROM {_CMO})),\nr("))
_ER = f"""(SELECT instrument, ts, close, CASE WHEN sum(dd) OVER {_ROWS10} > 0 THEN abs(close - first_value(close) OVER {_ROWS10}) / sum(dd) OVER {_ROWS10} ELSE 0 END AS er
FROM (SELECT *, abs(close - lag(close) OVER {_W}) AS dd FROM bars))"""
_add("fold_ama_10_2_30", lambda: O.Ama(10, 2, 30), ["close"], "ama double, ready boolean",
     recursive({"v": "x.close"}, {"v": f"r.v + pow(x.er * ({2 / 3!r} - {2 / 31!r}) + {2 / 31!r}, 2) * (x.close - r.v)"}, {"ama": "round(v, 6)", "ready": "i >= 10"}, "close, er").replace("FROM bars),\nr(", f"FROM {_ER}),\nr("))
_HU, _LD = "(x.high - r.h)", "(r.lo - x.low)"
_add("fold_directional_10", lambda: O.Directional(10), ["high", "low"], "pos double, neg double, ready boolean",
     recursive({"h": "x.high", "lo": "x.low", "u": "0", "d": "0"}, {"h": "x.high", "lo": "x.low", "u": _ema("u", f"CASE WHEN {_HU} > {_LD} AND {_HU} > 0 THEN {_HU} ELSE 0 END", A10), "d": _ema("d", f"CASE WHEN {_LD} > {_HU} AND {_LD} > 0 THEN {_LD} ELSE 0 END", A10)},
               {"pos": "round(u, 6)", "neg": "round(d, 6)", "ready": "i >= 10"}, "high, low"))
_TR = "(greatest(r.p, x.high) - least(x.low, r.p))"
_at, _av = _ema("a", _TR, A10), _ema("v", "x.volume", A10)
_press = lambda a, v: f"CASE WHEN {a} = 0 OR {v} = 0 THEN 0 ELSE ((x.close - x.low) - (x.high - x.close)) / ({a}) * x.volume / ({v}) END"
_a0 = "(greatest(x.close, x.high) - least(x.low, x.close))"
_add("fold_pressure_10", lambda: O.Pressure(10), ["high", "low", "close", "volume"], "pressure double, cumulative double, ready boolean",
     recursive({"p": "x.close", "a": _a0, "v": "x.volume", "s": _press(_a0, "x.volume"), "t": _press(_a0, "x.volume")}, {"p": "x.close", "a": _at, "v": _av, "s": _press(_at, _av), "t": f"r.t + {_press(_at, _av)}"},
               {"pressure": "round(s, 6)", "cumulative": "round(t, 6)", "ready": "i >= 10"}, "high, low, close, volume"))
_add("fold_trailing_stop_long", lambda: O.TrailingStop(1, 50.0), ["close"], "stop double, hit boolean", f"WITH {HOURLY_SQL}, x AS (SELECT instrument, ts, close, max(close - 50) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING) AS stop FROM bars) SELECT instrument, ts, round(stop, 6) AS stop, close - stop <= 0 AS hit FROM x")
_add("fold_trailing_stop_short_bp", lambda: O.TrailingStop(-1, 250.0, "basis_points"), ["close"], "stop double, hit boolean", f"WITH {HOURLY_SQL}, x AS (SELECT instrument, ts, close, min(close + close * 250 / 10000) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING) AS stop FROM bars) SELECT instrument, ts, round(stop, 6) AS stop, -(close - stop) <= 0 AS hit FROM x")
R.add("bars_renko_25", lambda s, d: O.fold(domain.trades(s, d), lambda: O.Renko(25.0), ["instrument"], ["ts", "seq"], ["price", "size"], "open double, high double, low double, close double, volume double"),
      f"""WITH RECURSIVE {domain.TRADES_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts, seq) AS i FROM trades),
r(instrument, ts, seq, i, c0, c1, k, v, g) AS (SELECT instrument, ts, seq, i, price, price, CAST(0 AS BIGINT), size, size FROM x WHERE i = 1
UNION ALL SELECT x.instrument, x.ts, x.seq, x.i, r.c1, round(r.c1 + sign(x.price - r.c1) * 25 * trunc(abs(round((x.price - r.c1) / 25, 9))), 9), CAST(trunc(abs(round((x.price - r.c1) / 25, 9))) AS BIGINT),
  r.g + x.size, CASE WHEN trunc(abs(round((x.price - r.c1) / 25, 9))) > 0 THEN 0 ELSE r.g + x.size END FROM r JOIN x ON x.instrument = r.instrument AND x.i = r.i + 1),
b AS (SELECT instrument, ts, seq, v AS volume, c0, sign(c1 - c0) AS s, unnest(range(k)) AS j FROM r WHERE k > 0)
SELECT instrument, ts, seq, round(c0 + s * 25 * j, 6) AS open, round(greatest(c0 + s * 25 * j, c0 + s * 25 * (j + 1)), 6) AS high, round(least(c0 + s * 25 * j, c0 + s * 25 * (j + 1)), 6) AS low, round(c0 + s * 25 * (j + 1), 6) AS close, round(volume, 6) AS volume FROM b""")  # fmt: skip
FILL_ORDER = ["ts", "order_id", "line", "qty", "px", "commission"]


def positions(spark, sf_dir):
    """Every fill's position after it, by account and instrument."""
    f = domain.fills(spark, sf_dir)
    f = f.withColumn("quantity", f["qty"]).withColumn("price", f["px"]).withColumn("fee", f["commission"])
    return O.fold(f, O.Position, ["account", "instrument"], FILL_ORDER, ["side", "quantity", "price", "fee"], O.POSITION_DDL)


POSITIONS_SQL = f"""RECURSIVE {domain.FILLS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY account, instrument ORDER BY ts, order_id, line, qty, px, commission) AS i FROM fills),
r(account, instrument, ts, order_id, line, qty, px, commission, i, q, ao, rp, ep, tot) AS (
  SELECT account, instrument, ts, order_id, line, qty, px, commission, i, side * qty, px, -commission, CAST(1 AS BIGINT), -commission FROM x WHERE i = 1
  UNION ALL
  SELECT x.account, x.instrument, x.ts, x.order_id, x.line, x.qty, x.px, x.commission, x.i, r.q + x.side * x.qty,
    CASE WHEN r.q = 0 OR (r.q * x.side < 0 AND x.qty > abs(r.q)) THEN x.px WHEN r.q * x.side > 0 THEN (r.ao * abs(r.q) + x.px * x.qty) / (abs(r.q) + x.qty) ELSE r.ao END,
    CASE WHEN r.q = 0 THEN -x.commission WHEN r.q * x.side > 0 THEN r.rp - x.commission WHEN x.qty > abs(r.q) THEN -x.commission * (x.qty - abs(r.q)) / x.qty ELSE r.rp - x.commission + x.qty * (x.px - r.ao) * sign(r.q) END,
    r.ep + CASE WHEN r.q = 0 OR (r.q * x.side < 0 AND x.qty > abs(r.q)) THEN 1 ELSE 0 END,
    r.tot - x.commission + CASE WHEN r.q * x.side < 0 THEN least(x.qty, abs(r.q)) * (x.px - r.ao) * sign(r.q) ELSE 0 END
  FROM r JOIN x ON x.account = r.account AND x.instrument = r.instrument AND x.i = r.i + 1)"""
#: Added before rounding, so that money that lies on a tie rounds alike in engines that add in different orders.
TIE = 1e-7
R.add("pos_fold", lambda s, d: positions(s, d).select("account", "instrument", "ts", "order_id", "line", "episode", *[(F.col(c) + TIE).alias(c) for c in ("signed_qty", "avg_px_open", "realized_pnl", "total_pnl")]),
      f"WITH {POSITIONS_SQL} SELECT account, instrument, ts, order_id, line, ep AS episode, " + ", ".join(f"round({e} + 1e-7, 4) AS {c}" for c, e in (("signed_qty", "q"), ("avg_px_open", "ao"), ("realized_pnl", "rp"), ("total_pnl", "tot"))) + " FROM r", 4)
