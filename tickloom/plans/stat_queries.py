"""Queries of statistics, positions, accounts and reports, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import stats
from tickloom.operators.windows import Series
from tickloom.plans.common import HOURLY_SQL, Registry, hourly
from tickloom.plans.fold_queries import POSITIONS_SQL, positions
from tickloom.sources import domain

R = Registry()


def returns(s, d):
    """A thousandth of the close's change, hour by hour."""
    b = hourly(s, d)
    return b.withColumn("r", (F.col("close") - Series("instrument", "ts").lag("close")) / 1000).where("r IS NOT NULL").select("instrument", "ts", "r")


RETURNS_SQL = HOURLY_SQL + ", rets AS (SELECT * FROM (SELECT instrument, ts, (close - lag(close) OVER (PARTITION BY instrument ORDER BY ts)) / 1000 AS r FROM bars) WHERE r IS NOT NULL)"
DAILY_SQL = RETURNS_SQL + ", daily AS (SELECT instrument, ts // 86400000000000 AS day, sum(r) AS r FROM rets GROUP BY 1, 2)"
EQUITY_SQL = RETURNS_SQL + """, e0 AS (SELECT instrument, ts, r, exp(sum(ln(1 + r)) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity FROM rets),
e1 AS (SELECT *, greatest(1, max(equity) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS peak FROM e0)"""
_S = "sqrt(252)"
R.add("stat_returns", lambda s, d: stats.return_statistics(returns(s, d), "instrument"),
      f"""WITH {DAILY_SQL}, a AS (SELECT instrument, avg(r) / stddev_samp(r) * {_S} AS sharpe, avg(r) / sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / count(*)) * {_S} AS sortino, stddev_samp(r) * {_S} AS volatility,
  pow(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1 AS cagr, count(*) AS days FROM daily GROUP BY 1),
b AS (SELECT instrument, avg(r) / stddev_samp(r) AS risk_return, abs(sum(r) FILTER (r > 0) / sum(r) FILTER (r < 0)) AS profit_factor, avg(r) FILTER (r <> 0) AS average, avg(r) FILTER (r > 0) AS average_win, avg(r) FILTER (r < 0) AS average_loss FROM rets GROUP BY 1)
SELECT instrument, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(volatility, 6) AS volatility, round(cagr, 6) AS cagr, days, round(risk_return, 6) AS risk_return, round(profit_factor, 6) AS profit_factor,
  round(average, 6) AS average, round(average_win, 6) AS average_win, round(average_loss, 6) AS average_loss FROM a JOIN b USING (instrument)""")  # fmt: skip
R.add("stat_drawdown_series", lambda s, d: stats.equity(returns(s, d), "instrument", ["ts"]).select("instrument", "ts", "equity", "drawdown"), f"WITH {EQUITY_SQL} SELECT instrument, ts, round(equity, 6) AS equity, round(100 * (equity - peak) / peak, 6) AS drawdown FROM e1")
R.add("stat_max_drawdown", lambda s, d: stats.max_drawdown(returns(s, d), "instrument", ["ts"]), f"WITH {EQUITY_SQL} SELECT instrument, round(min((equity - peak) / peak), 6) AS max_drawdown FROM e1 GROUP BY 1")
R.add("stat_calmar", lambda s, d: stats.calmar(returns(s, d), "instrument", ["ts"]),
      f"""WITH {EQUITY_SQL}, daily AS (SELECT instrument, ts // 86400000000000 AS day, sum(r) AS r FROM rets GROUP BY 1, 2), c AS (SELECT instrument, pow(exp(sum(ln(1 + r))), 252.0 / count(*)) - 1 AS cagr FROM daily GROUP BY 1),
m AS (SELECT instrument, min((equity - peak) / peak) AS mdd FROM e1 GROUP BY 1) SELECT instrument, round(cagr, 6) AS cagr, round(mdd, 6) AS max_drawdown, round(cagr / abs(mdd), 6) AS calmar FROM c JOIN m USING (instrument)""")  # fmt: skip
R.add("stat_rolling_sharpe_10", lambda s, d: stats.rolling_sharpe(returns(s, d), "instrument", 10),
      f"WITH {DAILY_SQL} SELECT instrument, day, round(r, 6) AS r, round(CASE WHEN count(*) OVER w >= 10 THEN avg(r) OVER w / stddev_samp(r) OVER w * {_S} END, 6) AS sharpe FROM daily WINDOW w AS (PARTITION BY instrument ORDER BY day ROWS 9 PRECEDING)")
R.add("stat_weekly_returns", lambda s, d: stats.periodic_returns(returns(s, d), "instrument"), f"WITH {RETURNS_SQL} SELECT instrument, CAST(CAST(date_trunc('week', make_timestamp(ts // 1000)) AS DATE) AS VARCHAR) AS period, round(exp(sum(ln(1 + r))) - 1, 6) AS r FROM rets GROUP BY 1, 2")
R.add("stat_monthly_table", lambda s, d: stats.monthly_table(returns(s, d), "instrument"),
      f"WITH {RETURNS_SQL} SELECT instrument, CAST(year(make_timestamp(ts // 1000)) AS INTEGER) AS year, " + ", ".join(f"round(exp(sum(CASE WHEN month(make_timestamp(ts // 1000)) = {k} THEN ln(1 + r) ELSE 0 END)) - 1, 6) AS m{k:02d}" for k in range(1, 13)) + " FROM rets GROUP BY 1, 2")
R.add("stat_histogram", lambda s, d: stats.histogram(returns(s, d), "instrument", -0.2, 0.2, 8), f"WITH {RETURNS_SQL} SELECT instrument, CAST(CASE WHEN r < -0.2 THEN 0 WHEN r >= 0.2 THEN 9 ELSE floor((r + 0.2) / 0.4 * 8) + 1 END AS BIGINT) AS bin, count(*) AS n FROM rets GROUP BY 1, 2")


def closed_positions(s, d):
    """A row a position: its last state; entry is the side that opened it."""
    p = positions(s, d)
    at = F.struct("ts", "order_id", "line", "qty", "px", "commission")
    g = p.groupBy("account", "instrument", "episode").agg(F.max_by("realized_pnl", at).alias("pnl"), F.max_by("signed_qty", at).alias("qty"), F.min_by(F.signum("signed_qty"), at).alias("entry"), F.max("ts").alias("ts_last"))
    return g.withColumn("entry", F.col("entry").cast("int"))


EPISODES_SQL = POSITIONS_SQL + ", ep AS (SELECT account, instrument, ep AS episode, arg_max(rp, i) AS pnl, arg_max(q, i) AS qty, CAST(sign(arg_min(q, i)) AS INTEGER) AS entry FROM r GROUP BY 1, 2, 3)"
R.add("pos_net", lambda s, d: domain.fills(s, d).groupBy("account", "instrument").agg(F.sum(F.col("side") * F.col("qty")).alias("net_qty"), F.sum(-F.col("side") * F.col("qty") * F.col("px") - F.col("commission")).alias("cash")),
      f"WITH {domain.FILLS_SQL} SELECT account, instrument, sum(side * qty) AS net_qty, round(sum(-side * qty * px - commission), 4) AS cash FROM fills GROUP BY 1, 2", 4)
R.add("stat_pnls", lambda s, d: stats.pnl_statistics(closed_positions(s, d), "account"),
      f"""WITH {EPISODES_SQL}, z AS (SELECT account, count(*) AS n, sum(pnl) AS total, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, coalesce(max(pnl) FILTER (pnl > 0), 0) AS max_winner, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_winner,
  coalesce(min(pnl) FILTER (pnl > 0), 0) AS min_winner, coalesce(min(pnl) FILTER (pnl < 0), 0) AS max_loser, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS avg_loser, coalesce(max(pnl) FILTER (pnl < 0), 0) AS min_loser FROM ep GROUP BY 1)
SELECT account, n, round(total, 3) AS total, round(win_rate, 3) AS win_rate, round(avg_winner * win_rate + avg_loser * (1 - win_rate), 3) AS expectancy, round(max_winner, 3) AS max_winner, round(avg_winner, 3) AS avg_winner, round(min_winner, 3) AS min_winner,
  round(max_loser, 3) AS max_loser, round(avg_loser, 3) AS avg_loser, round(min_loser, 3) AS min_loser FROM z""", 3)  # fmt: skip
R.add("stat_long_ratio", lambda s, d: stats.long_ratio(closed_positions(s, d), "instrument", 4), f"WITH {EPISODES_SQL} SELECT instrument, round(avg(CASE WHEN entry = 1 THEN 1.0 ELSE 0.0 END), 4) AS long_ratio FROM ep GROUP BY 1", 4)
R.add("report_open_positions", lambda s, d: closed_positions(s, d).where("qty <> 0").groupBy("account").agg(F.count("*").alias("open"), F.sum(F.when(F.col("qty") > 0, 1).otherwise(0)).alias("long"), F.sum(F.when(F.col("qty") < 0, 1).otherwise(0)).alias("short")),
      f"WITH {EPISODES_SQL} SELECT account, count(*) AS open, CAST(count(*) FILTER (qty > 0) AS BIGINT) AS long, CAST(count(*) FILTER (qty < 0) AS BIGINT) AS short FROM ep WHERE qty <> 0 GROUP BY 1")
