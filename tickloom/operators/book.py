"""Order books from deltas: state by aggregation, queries on levels.

Deltas: instrument, action (ADD, UPDATE, DELETE, CLEAR), side, price, size, order_id, ts, seq.
Levels: instrument, side, price, size, orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def open_orders(deltas: DataFrame, at: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Orders on the book after all deltas (up to ts ``at``): one aggregation, no fold.

    An order lives if it was added after its last deletion and after the instrument's last CLEAR;
    its values are those of its last ADD or UPDATE since. Updates and deletions of unknown orders
    are ignored. ``key``: what names an order (order_id; for level 2, side and price).
    """
    key = key or ["order_id"]
    d = deltas if at is None else deltas.where(F.col("ts") <= at)
    place = F.struct("ts", "seq")
    clears = d.where("action = 'CLEAR'").groupBy("instrument").agg(F.max(place).alias("cleared"))
    d = d.where("action <> 'CLEAR'").join(clears, "instrument", "left").where("cleared IS NULL OR struct(ts, seq) > cleared")
    keep = [c for c in ("side", "price", "size") if c not in key]
    g = d.groupBy("instrument", *key).agg(
        F.max(F.when(F.col("action") == "ADD", place)).alias("added"), F.max(F.when(F.col("action") == "DELETE", place)).alias("gone"),
        F.max_by(F.struct(*keep), F.when(F.col("action") != "DELETE", place)).alias("v"), F.max(F.when(F.col("action") != "DELETE", place)).alias("placed"),
    )
    live = F.col("added").isNotNull() & (F.col("gone").isNull() | (F.col("added") > F.col("gone")))
    return g.where(live).select("instrument", *key, *[F.col(f"v.{c}").alias(c) for c in keep], F.col("placed.ts").alias("ts"), F.col("placed.seq").alias("seq")).where("size > 0")


def levels(orders: DataFrame) -> DataFrame:
    return orders.groupBy("instrument", "side", "price").agg(F.sum("size").alias("size"), F.count("*").alias("orders"))


def _best_first(price: str = "price") -> Column:
    """Sort key: bids from the highest, asks from the lowest."""
    return F.when(F.col("side") == "BUY", -F.col(price)).otherwise(F.col(price))


def top(levels_: DataFrame) -> DataFrame:
    """Best prices and sizes, spread and midpoint of each instrument; null where a side is empty."""
    at = _best_first()
    side = lambda s, c: F.min_by(c, F.when(F.col("side") == s, at))
    out = levels_.groupBy("instrument").agg(*[side(s, c).alias(f"{n}_{c}") for s, n in (("BUY", "bid"), ("SELL", "ask")) for c in ("price", "size")])
    return out.withColumn("spread", F.col("ask_price") - F.col("bid_price")).withColumn("midpoint", (F.col("ask_price") + F.col("bid_price")) / 2)


def depth(levels_: DataFrame, k: int) -> DataFrame:
    """The best k levels a side, numbered from 1."""
    w = W.partitionBy("instrument", "side").orderBy(_best_first())
    return levels_.withColumn("level", F.row_number().over(w).cast("long")).where(F.col("level") <= k)


def grouped(levels_: DataFrame, size: float, k: int | None = None) -> DataFrame:
    """Levels in price groups: bids down, asks up to a multiple of ``size``; the best k groups. Not positive: none."""
    if size <= 0:
        return levels_.limit(0).select("instrument", "side", "price", "size")
    to = F.when(F.col("side") == "BUY", F.floor(F.col("price") / size)).otherwise(F.ceil(F.col("price") / size)) * size
    g = levels_.withColumn("price", to).groupBy("instrument", "side", "price").agg(F.sum("size").alias("size"))
    return depth(g, k).drop("level") if k else g


def without_own(levels_: DataFrame, own: DataFrame) -> DataFrame:
    """Levels less one's own size there, none below zero; emptied levels go."""
    o = own.groupBy("instrument", "side", "price").agg(F.sum("size").alias("own"))
    return levels_.join(o, ["instrument", "side", "price"], "left").withColumn("size", F.greatest(F.col("size") - F.coalesce("own", F.lit(0.0)), F.lit(0.0))).where("size > 0").drop("own")


def _running(levels_: DataFrame, value: str) -> DataFrame:
    """Levels with the sum of ``value`` before and up to each, from the best on."""
    w = W.partitionBy("instrument", "side").orderBy(_best_first())
    return levels_.withColumn("upto", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col(value))


def quantity_for_price(levels_: DataFrame, price: float) -> DataFrame:
    """Size that an order with this limit can take: asks up to it for a buy, bids down to it for a sell."""
    buy = F.sum(F.when((F.col("side") == "SELL") & (F.col("price") <= price), F.col("size")))
    sell = F.sum(F.when((F.col("side") == "BUY") & (F.col("price") >= price), F.col("size")))
    return levels_.groupBy("instrument").agg(F.coalesce(buy, F.lit(0.0)).alias("buy_qty"), F.coalesce(sell, F.lit(0.0)).alias("sell_qty"))


def sweep(levels_: DataFrame, qty: float) -> DataFrame:
    """Average price of taking ``qty`` from a side, and what was taken (less if the side is short)."""
    r = _running(levels_, "size").withColumn("take", F.least("size", F.greatest(qty - F.col("before"), F.lit(0.0)))).where("take > 0")
    return r.groupBy("instrument", "side").agg((F.sum(F.col("price") * F.col("take")) / F.sum("take")).alias("avg_px"), F.sum("take").alias("qty"))


def sweep_exposure(levels_: DataFrame, target: float) -> DataFrame:
    """Average price, quantity and last price of taking a notional of ``target``; clipped on the target itself."""
    r = _running(levels_.withColumn("value", F.col("price") * F.col("size")), "value")
    r = r.withColumn("take", F.least("value", F.greatest(target - F.col("before"), F.lit(0.0)))).where("take > 0 AND price > 0")
    q = F.sum(F.col("take") / F.col("price"))
    return r.groupBy("instrument", "side").agg((F.sum("take") / q).alias("avg_px"), q.alias("qty"), F.max_by("price", _best_first()).alias("last_px"))


def simulate_fills(orders: DataFrame, side: str, qty: float, limit: float | None = None) -> DataFrame:
    """Fills of a marketable order against resting ones, best price first, then oldest."""
    r = orders.where(F.col("side") == ("SELL" if side == "BUY" else "BUY"))
    if limit is not None:
        r = r.where(F.col("price") <= limit if side == "BUY" else F.col("price") >= limit)
    w = W.partitionBy("instrument").orderBy(_best_first(), "ts", "seq")
    r = r.withColumn("before", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    return r.withColumn("fill", F.least("size", F.greatest(qty - F.col("before"), F.lit(0.0)))).where("fill > 0").select("instrument", "order_id", "price", "fill")


def uncrossed(levels_: DataFrame) -> DataFrame:
    """A crossed book without its stale levels: bids at or above the best ask, asks at or below the best bid."""
    w = W.partitionBy("instrument")
    bid, ask = F.max(F.when(F.col("side") == "BUY", F.col("price"))).over(w), F.min(F.when(F.col("side") == "SELL", F.col("price"))).over(w)
    x = levels_.withColumn("_b", bid).withColumn("_a", ask)
    crossed = F.coalesce(F.col("_b") >= F.col("_a"), F.lit(False))
    stale = F.when(F.col("side") == "BUY", F.col("price") >= F.col("_a")).otherwise(F.col("price") <= F.col("_b"))
    return x.where(~crossed | ~stale).drop("_b", "_a")


def integrity(levels_: DataFrame) -> DataFrame:
    """Per instrument: levels a side and whether the best bid is below the best ask."""
    t = top(levels_).select("instrument", F.coalesce(F.col("bid_price") < F.col("ask_price"), F.lit(True)).alias("uncrossed"))
    n = levels_.groupBy("instrument").agg(F.sum(F.when(F.col("side") == "BUY", 1).otherwise(0)).alias("bids"), F.sum(F.when(F.col("side") == "SELL", 1).otherwise(0)).alias("asks"))
    return n.join(t, "instrument")


def exposure(levels_: DataFrame) -> DataFrame:
    return levels_.groupBy("instrument", "side").agg(F.sum("size").alias("size"), F.sum(F.col("price") * F.col("size")).alias("exposure"))


def batches(deltas: DataFrame) -> DataFrame:
    """Deltas with their batch: a batch ends with a row whose ``last`` flag is set."""
    w = W.partitionBy("instrument").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    return deltas.withColumn("batch", F.coalesce(F.sum(F.col("last").cast("long")).over(w), F.lit(0)))


def audit_open(own: DataFrame, open_ids: DataFrame) -> DataFrame:
    """One's own orders that the venue still has."""
    return own.join(open_ids, "order_id", "left_semi")


def depth_arrays(levels_: DataFrame, k: int = 10) -> DataFrame:
    """One row an instrument: arrays of the k best (price, size, orders), best first; asks and bids."""
    d = depth(levels_, k)
    entry = F.struct("level", "price", "size", "orders")
    pick = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, entry))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"), x["orders"].alias("orders")))
    return d.groupBy("instrument").agg(pick("BUY").alias("bids"), pick("SELL").alias("asks"))


def from_depth(depths: DataFrame) -> DataFrame:
    """Levels of the latest depth row of each instrument; padding (size 0) goes."""
    last = depths.groupBy("instrument").agg(F.max_by(F.struct("bids", "asks"), F.struct("ts", "seq")).alias("d"))
    side = lambda c, s: last.select("instrument", F.explode(f"d.{c}").alias("x")).select("instrument", F.lit(s).alias("side"), "x.price", "x.size", "x.orders")
    return side("bids", "BUY").union(side("asks", "SELL")).where("size > 0")
