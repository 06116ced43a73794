"""Portfolio statistics. Returns: key, ts (ns), r. PnLs: key, pnl. All are single aggregations but the drawdowns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.windows import Series

DAY = 86400 * 10**9


def _nan() -> Column:
    return F.lit(float("nan"))


def daily(returns: DataFrame, key: str) -> DataFrame:
    """Sum of returns by UTC day; days without any are not made up."""
    return returns.groupBy(key, F.expr(f"ts div {DAY}").alias("day")).agg(F.sum("r").alias("r"))


def compounded(r: Column, total: Callable[[Column], Column]) -> Column:
    """Product of 1 + r by sums of logarithms, signs and zeros; ``total`` sums a column (plainly or over a window). A loss of all is 0, a larger one changes the sign."""
    factor = 1 + r
    logs = total(F.when(factor == 0, 0.0).otherwise(F.log(F.abs(factor))))
    sign = F.when(total(F.when(factor < 0, 1).otherwise(0)) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(total(F.when(factor == 0, 1).otherwise(0)) > 0, 0.0).otherwise(sign * F.exp(logs))


def return_statistics(returns: DataFrame, key: str, period: int = 252) -> DataFrame:
    """Sharpe, Sortino, volatility, CAGR (daily bins); risk-return, profit factor, averages (raw); NaN where undefined."""
    d = daily(returns, key)
    mean, sd, n = F.avg("r"), F.stddev_samp("r"), F.count("*")
    down = F.sqrt(F.sum(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(0.0)) / n)
    growth = compounded(F.col("r"), F.sum)
    by_day = d.groupBy(key).agg(
        F.when((n > 1) & (sd > 1e-12), mean / sd * period**0.5).otherwise(_nan()).alias("sharpe"),
        F.when(down > 1e-12, mean / down * period**0.5).otherwise(_nan()).alias("sortino"),
        F.when(n > 1, sd * period**0.5).otherwise(_nan()).alias("volatility"),
        (F.pow(growth, period / n) - 1).alias("cagr"), n.alias("days"),
    )
    gain, loss = F.sum(F.when(F.col("r") > 0, F.col("r"))), F.sum(F.when(F.col("r") < 0, F.col("r")))
    raw = returns.groupBy(key).agg(
        F.when((F.count("*") > 1) & (sd > 1e-12), mean / sd).otherwise(_nan()).alias("risk_return"),
        F.when(loss < 0, F.abs(F.coalesce(gain, F.lit(0.0)) / loss)).otherwise(_nan()).alias("profit_factor"),
        F.coalesce(F.avg(F.when(F.col("r") != 0, F.col("r"))), _nan()).alias("average"),
        F.coalesce(F.avg(F.when(F.col("r") > 0, F.col("r"))), _nan()).alias("average_win"),
        F.coalesce(F.avg(F.when(F.col("r") < 0, F.col("r"))), _nan()).alias("average_loss"),
    )
    return by_day.join(raw, key)


def equity(returns: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Compounded curve from 1, its peak (1 at least), and the drawdown in percent at every return."""
    s = Series(key, *order)
    e = returns.withColumn("equity", compounded(F.col("r"), lambda c: F.sum(c).over(s.all)))
    e = e.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(s.all)))
    return e.withColumn("drawdown", 100 * (F.col("equity") - F.col("peak")) / F.col("peak"))


def max_drawdown(returns: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Largest fall below the peak, as a negative share, on raw returns."""
    return equity(returns, key, order).groupBy(key).agg((F.min("drawdown") / 100).alias("max_drawdown"))


def calmar(returns: DataFrame, key: str, order: list[str]) -> DataFrame:
    c = return_statistics(returns, key).select(key, "cagr").join(max_drawdown(returns, key, order), key)
    return c.withColumn("calmar", F.when(F.abs("max_drawdown") > 1e-12, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0))


def pnl_statistics(pnls: DataFrame, key: str) -> DataFrame:
    """Win rate, expectancy and the largest, mean and smallest winners (above 0) and losers (the mean one takes 0 in)."""
    p = F.col("pnl")
    win, lose, flat = F.when(p > 0, p), F.when(p < 0, p), F.when(p <= 0, p)
    rate = F.avg(F.when(p > 0, 1.0).otherwise(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return pnls.groupBy(key).agg(
        F.count("*").alias("n"), F.sum("pnl").alias("total"), rate.alias("win_rate"),
        (zero(F.avg(win)) * rate + zero(F.avg(flat)) * (1 - rate)).alias("expectancy"),
        zero(F.max(win)).alias("max_winner"), zero(F.avg(win)).alias("avg_winner"), zero(F.min(win)).alias("min_winner"),
        zero(F.min(lose)).alias("max_loser"), zero(F.avg(flat)).alias("avg_loser"), zero(F.max(lose)).alias("min_loser"),
    )


def long_ratio(positions: DataFrame, key: str, precision: int = 2) -> DataFrame:
    """Share of positions that were entered by a buy."""
    return positions.groupBy(key).agg(F.round(F.avg(F.when(F.col("entry") == 1, 1.0).otherwise(0.0)), precision).alias("long_ratio"))


def rolling_sharpe(returns: DataFrame, key: str, n: int) -> DataFrame:
    """Of the last n daily returns; null until there are n, or if they don't vary."""
    w = W.partitionBy(key).orderBy("day").rowsBetween(-(n - 1), 0)
    sd = F.stddev_samp("r").over(w)
    return daily(returns, key).withColumn("sharpe", F.when((F.count("*").over(w) >= n) & (sd > 1e-12), F.avg("r").over(w) / sd * 252**0.5))


def periodic_returns(returns: DataFrame, key: str, unit: str = "week") -> DataFrame:
    """Compounded returns by calendar unit."""
    start = F.to_date(F.date_trunc(unit, F.timestamp_micros(F.expr("ts div 1000"))))
    return returns.groupBy(key, start.cast("string").alias("period")).agg((compounded(F.col("r"), F.sum) - 1).alias("r"))


def monthly_table(returns: DataFrame, key: str) -> DataFrame:
    """A row a year, a column a month; empty months are 0."""
    t = F.timestamp_micros(F.expr("ts div 1000"))
    m = returns.withColumn("year", F.year(t)).withColumn("month", F.month(t))
    value = lambda k: compounded(F.when(F.col("month") == k, F.col("r")).otherwise(0.0), F.sum) - 1
    return m.groupBy(key, "year").agg(*[value(k).alias(f"m{k:02d}") for k in range(1, 13)])


def histogram(returns: DataFrame, key: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins; 0 and bins + 1 hold what lies outside."""
    at = F.width_bucket("r", F.lit(low), F.lit(high), F.lit(bins))
    return returns.groupBy(key, at.alias("bin")).agg(F.count("*").alias("n"))
