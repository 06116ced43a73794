"""From trades to bars. Input columns: instrument, price, size, ts (ns), seq; bars have open, high, low, close, volume, n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.windows import Series

SECOND, MINUTE, HOUR, DAY = 10**9, 60 * 10**9, 3600 * 10**9, 86400 * 10**9


def ohlcv(rows: DataFrame, keys: list[str], volume: str = "size") -> DataFrame:
    """One pass with partial aggregation: first and last by (ts, seq)."""
    at = F.struct("ts", "seq")
    return rows.groupBy(*keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum(volume).alias("volume"), F.count("*").alias("n"),
    )


def time_bucket(ts: str, step: int, origin: int = 0, closed: str = "right") -> Column:
    """The bucket's end (ns). Steps that don't divide a day start again each UTC day.

    ``closed="right"``: (start, end]; ``"left"``: [start, end).
    """
    t = f"({ts} - {1 if closed == 'right' else 0} - {origin})"
    day = f"({t} - pmod({t}, {DAY}))"
    inside = f"pmod({t}, {DAY})" if DAY % step else f"pmod({t}, {step})"
    start = f"{day} + ({inside} div {step}) * {step}" if DAY % step else f"{t} - {inside}"
    return F.expr(f"{start} + {step} + {origin}")


def time_bars(trades: DataFrame, step: int, origin: int = 0, closed: str = "right", on_close: bool = True, skip_first: bool = False) -> DataFrame:
    """Bars of a fixed step; ts is the bar's end, or its start with ``on_close=False``. ``skip_first`` drops a key's first bar."""
    out = ohlcv(trades.withColumn("bar", time_bucket("ts", step, origin, closed)), ["instrument", "bar"])
    if skip_first:
        out = out.withColumn("_n", Series("instrument", "bar").number()).where("_n > 1").drop("_n")
    return out.withColumn("ts", F.col("bar") if on_close else F.col("bar") - step).drop("bar")


def calendar_bars(trades: DataFrame, unit: str, step: int = 1) -> DataFrame:
    """Bars by week (from Monday), month (steps from January) or year; ts is the period's start (ns)."""
    t = F.timestamp_micros(F.expr("ts div 1000"))
    if unit == "month":
        start = F.add_months(F.trunc(t, "year"), F.expr(f"cast(floor((month(timestamp_micros(ts div 1000)) - 1) / {step}) * {step} as int)"))
    else:
        start = F.trunc(t, unit)
    return ohlcv(trades.withColumn("bar", F.unix_micros(start.cast("timestamp")) * 1000), ["instrument", "bar"]).withColumnRenamed("bar", "ts")


def fill_gaps(bars: DataFrame, step: int) -> DataFrame:
    """Bars for all steps between a key's first and last one: an empty one repeats the last close and has volume 0."""
    spine = bars.groupBy("instrument").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("instrument", F.explode(F.sequence("a", "b", F.lit(step))).alias("ts"))
    all_ = spine.join(bars, ["instrument", "ts"], "left")
    s = Series("instrument", "ts")
    close = s.held("close")
    return all_.select("instrument", "ts", *[F.coalesce(c, close).alias(c) for c in ("open", "high", "low")], close.alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("n", F.lit(0)).alias("n"))


def tick_bars(trades: DataFrame, step: int) -> DataFrame:
    """A bar every ``step`` trades; the incomplete last one is not emitted."""
    bar = F.floor((Series("instrument", "ts", "seq").number() - 1) / step)
    return ohlcv(trades.withColumn("bar", bar), ["instrument", "bar"]).where(F.col("n") == step)


def _split_bars(trades: DataFrame, amount: Column, step: float, piece: Column) -> DataFrame:
    """Trades laid end to end by ``amount`` and cut at multiples of ``step``; a trade may lie in many bars."""
    rows = trades.where("size > 0").withColumn("amount", amount).where("amount > 0")
    to = F.sum("amount").over(Series("instrument", "ts", "seq").all)
    rows = rows.withColumn("to", to).withColumn("from", F.col("to") - F.col("amount"))
    first, last = F.floor(F.col("from") / step).cast("long"), F.ceil(F.col("to") / step).cast("long") - 1
    rows = rows.withColumn("bar", F.explode(F.sequence(first, last)))
    part = F.least("to", (F.col("bar") + 1) * step) - F.greatest("from", F.col("bar") * step)
    rows = rows.withColumn("part", part).where("part > 0").withColumn("size", piece)
    out = ohlcv(rows, ["instrument", "bar"])
    total = rows.groupBy("instrument").agg(F.max("to").alias("all"))
    return out.join(total, "instrument").where((F.col("bar") + 1) * step <= F.col("all")).drop("all")


def volume_bars(trades: DataFrame, step: float) -> DataFrame:
    """Bars of exactly ``step`` volume: a trade that passes a bar's end is split. Trades of size 0 don't count."""
    return _split_bars(trades, F.col("size"), step, F.col("part"))


def value_bars(trades: DataFrame, step: int, scale: int = 4) -> DataFrame:
    """Bars of exactly ``step`` notional (price times size, in integer units of 10**-scale, so that cuts are exact)."""
    unit = 10**scale
    amount = F.round(F.col("price") * F.col("size") * unit).cast("long")
    return _split_bars(trades, amount, step * unit, F.col("size") * F.col("part") / F.col("amount"))


def composite_bars(bars: DataFrame, step: int, closed: str = "right") -> DataFrame:
    """Bars of bars: first open, highest high, lowest low, last close, summed volume."""
    b = bars.withColumn("bar", time_bucket("ts", step, closed=closed))
    return b.groupBy("instrument", "bar").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("n").alias("n"),
    ).withColumnRenamed("bar", "ts")


def monotone(rows: DataFrame) -> DataFrame:
    """Whether each instrument's rows, in seq order, never go back in time."""
    w = W.partitionBy("instrument").orderBy("seq")
    return rows.withColumn("back", F.col("ts") < F.lag("ts").over(w)).groupBy("instrument").agg(F.coalesce(~F.bool_or("back"), F.lit(True)).alias("monotone"))


def drop_late(rows: DataFrame) -> DataFrame:
    """Rows in arrival order (seq) without those older than one that came before (a builder's late rule)."""
    before = F.max("ts").over(W.partitionBy("instrument").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_before", before).where("_before IS NULL OR ts >= _before").drop("_before")
