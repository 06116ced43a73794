"""Projections that make typed events from raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_init(df: DataFrame, delta: int, ts: str = "ts_event") -> DataFrame:
    """ts_init: the event's time plus a fixed latency (ns)."""
    return df.withColumn("ts_init", F.col(ts) + delta)


def clean_bars(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Bars without rows that lack a price, unscaled."""
    cols = [c for c in ("open", "high", "low", "close", "volume") if c in df.columns]
    return df.dropna(subset=cols).select(*[(F.col(c) / scale).alias(c) if c in cols else F.col(c) for c in df.columns])


def quotes_from(df: DataFrame, digits: int, default_size: float = 1_000_000.0) -> DataFrame:
    """Quotes rounded to the instrument's precision; missing sizes get the default."""
    size = lambda c: F.coalesce(F.col(c), F.lit(default_size)) if c in df.columns else F.lit(default_size)
    return df.select("instrument", F.round("bid", digits).alias("bid"), F.round("ask", digits).alias("ask"), size("bid_size").alias("bid_size"), size("ask_size").alias("ask_size"), "ts")


def _four(columns: list[str], offset: int, close_stamped: bool) -> Column:
    """Open, high, low and close, in this order, at their offsets around the bar's stamp."""
    shifts = (-3, -2, -1, 0) if close_stamped else (0, 1, 2, 3)
    rows = [F.struct(F.lit(i).alias("part"), (F.col("ts") + s * offset).alias("at"), *[F.col(f"{p}{n}").alias(p or "price") for p in columns]) for i, (n, s) in enumerate(zip(("open", "high", "low", "close"), shifts, strict=True))]
    return F.explode(F.array(*rows))


def quarter_size(volume: Column, step: float, digits: int) -> Column:
    """A quarter of a bar's volume, at least one size step."""
    return F.round(F.greatest(volume / 4, F.lit(step)), digits)


def bars_to_quotes(bids: DataFrame, asks: DataFrame, offset: int = 100 * 10**6, close_stamped: bool = True, step: float = 1.0, digits: int = 0) -> DataFrame:
    """Bid and ask bars of the same times, each as four quotes."""
    pre = lambda df, p: df.select("instrument", "ts", *[F.col(c).alias(f"{p}{c}") for c in ("open", "high", "low", "close", "volume")])
    both = pre(bids, "bid").join(pre(asks, "ask"), ["instrument", "ts"])
    x = both.withColumn("x", _four(["bid", "ask"], offset, close_stamped))
    return x.select("instrument", F.col("x.at").alias("ts"), F.col("x.part").alias("part"), F.col("x.bid").alias("bid"), F.col("x.ask").alias("ask"), quarter_size(F.col("bidvolume"), step, digits).alias("bid_size"), quarter_size(F.col("askvolume"), step, digits).alias("ask_size"))


def bars_to_trades(bars: DataFrame, offset: int = 100 * 10**6, close_stamped: bool = True, step: float = 1.0, digits: int = 0) -> DataFrame:
    """Bars, each as four trades without an aggressor; the trade id is the time as text."""
    x = bars.withColumn("x", _four([""], offset, close_stamped))
    return x.select("instrument", F.col("x.at").alias("ts"), F.col("x.part").alias("part"), F.col("x.price").alias("price"), quarter_size(F.col("volume"), step, digits).alias("size"), F.lit("NO_AGGRESSOR").alias("aggressor"), F.col("x.at").cast("string").alias("trade_id"))


def aggressor(df: DataFrame) -> Column:
    """From ``side`` (text), else ``buyer_maker`` (a buyer who makes is hit by a seller), else none."""
    if "side" in df.columns:
        s = F.upper("side")
        return F.when(s.isin("BUY", "BUYER", "B"), "BUYER").when(s.isin("SELL", "SELLER", "S"), "SELLER").otherwise("NO_AGGRESSOR")
    if "buyer_maker" in df.columns:
        return F.when(F.col("buyer_maker"), "SELLER").when(~F.col("buyer_maker"), "BUYER").otherwise("NO_AGGRESSOR")
    return F.lit("NO_AGGRESSOR")


def snapshot_clear(deltas: DataFrame, flag: int = 32) -> DataFrame:
    """Deltas with a CLEAR before the first row of each instrument whose flags hold the snapshot bit."""
    first = deltas.groupBy("instrument").agg(F.min_by(F.struct("flags", "ts", "seq"), F.struct("ts", "seq")).alias("f"))
    clear = first.where(F.col("f.flags").bitwiseAND(flag) != 0).select("instrument", F.lit("CLEAR").alias("action"), F.col("f.ts").alias("ts"), (F.col("f.seq") - 1).alias("seq"), F.lit(flag).alias("flags"))
    return deltas.unionByName(clear, allowMissingColumns=True)


def fee(kind: str, **p: float) -> Column:
    """Fee of a fill: ``fixed`` (once an order, on its first fill), ``maker_taker`` (by notional), ``per_contract``."""
    if kind == "fixed":
        return F.when(F.col("first_fill"), p["amount"]).otherwise(0.0)
    if kind == "maker_taker":
        return F.col("qty") * F.col("px") * F.when(F.col("maker"), p["maker"]).otherwise(p["taker"])
    if kind == "per_contract":
        return F.col("qty") * p["amount"]
    raise ValueError(f"no such fee model: {kind}")
