"""Order states, fill and latency models, reconciliation prices: expressions on orders and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Which event takes an order from a state to which; an event whose state differs from its name is written event:state. Fixed values.
TRANSITIONS = {
    "INITIALIZED": "DENIED EMULATED RELEASED SUBMITTED REJECTED ACCEPTED CANCELED EXPIRED TRIGGERED",
    "EMULATED": "CANCELED EXPIRED RELEASED",
    "RELEASED": "SUBMITTED DENIED CANCELED",
    "SUBMITTED": "PENDING_UPDATE PENDING_CANCEL REJECTED CANCELED ACCEPTED FILLED UPDATED:SUBMITTED",
    "ACCEPTED": "REJECTED PENDING_UPDATE PENDING_CANCEL CANCELED TRIGGERED EXPIRED FILLED UPDATED:ACCEPTED",
    "CANCELED": "FILLED",
    "PENDING_UPDATE": "REJECTED ACCEPTED CANCELED EXPIRED TRIGGERED PENDING_UPDATE PENDING_CANCEL MODIFY_REJECTED:PENDING_UPDATE FILLED",
    "PENDING_CANCEL": "REJECTED PENDING_CANCEL CANCEL_REJECTED:PENDING_CANCEL CANCELED EXPIRED ACCEPTED FILLED",
    "TRIGGERED": "REJECTED PENDING_UPDATE PENDING_CANCEL CANCELED EXPIRED FILLED",
    "PARTIALLY_FILLED": "PENDING_UPDATE PENDING_CANCEL CANCELED EXPIRED FILLED ACCEPTED",
}


def _table() -> dict[str, str]:
    out = {}
    for state, events in TRANSITIONS.items():
        for e in events.split():
            event, _, to = e.partition(":")
            out[f"{state}>{event}"] = to or event
    return out


def next_state(state: Column, event: Column) -> Column:
    """The state after an event; null if the event is not allowed."""
    pairs = [F.lit(x) for kv in sorted(_table().items()) for x in kv]
    return F.create_map(*pairs)[F.concat_ws(">", state, event)]


class OrderState:
    """The same as a fold: rows (event, filled share of the order so far); emits the state and whether the event was allowed."""

    def __init__(self) -> None:
        self.state, self.table = "INITIALIZED", _table()

    def step(self, row):
        event, filled = row
        to = self.table.get(f"{self.state}>{event}")
        if to is not None:
            self.state = "PARTIALLY_FILLED" if to == "FILLED" and filled < 1 else to
        return [(self.state, to is not None)]


def invalid_transitions(events: DataFrame) -> DataFrame:
    """Events (order_id, ts, seq, state: what the event left the order in, event) that their order's last state does not allow."""
    before = F.coalesce(F.lag("state").over(W.partitionBy("order_id").orderBy("ts", "seq")), F.lit("INITIALIZED"))
    return events.withColumn("before", before).where(next_state(F.col("before"), F.col("event")).isNull())


#: Tiers of the fill models: ticks worse than the best price, and size there (None: no end). Fixed values.
FILL_TIERS = {
    "best_price": ((0, None),),
    "one_tick_slippage": ((1, None),),
    "two_tier": ((0, 10.0), (1, None)),
    "three_tier": ((0, 50.0), (1, 30.0), (2, 20.0)),
    "partial_limit": ((0, 5.0), (1, None)),
}


def tiers_of(model: str, qty: Column, **p) -> list[tuple[Column | int, Column | float | None]]:
    """Tiers of a model for an order of this size; models that look at the order or the market take parameters."""
    if model in FILL_TIERS:
        return list(FILL_TIERS[model])
    if model == "probabilistic":  # a keyed hash of the order stands for the coin: reruns agree
        slip = F.pmod(F.xxhash64(F.lit(p.get("seed", 0)), p["order"]), F.lit(1_000_000)) < int(1_000_000 * p.get("probability", 0.5))
        return [(F.when(slip, 1).otherwise(0), None)]
    if model == "size_aware":
        small = qty <= 10
        return [(0, F.when(small, 50.0).otherwise(10.0)), (1, F.when(small, 0.0).otherwise(qty - 10))]
    if model == "market_hours":
        return [(F.when(p["low_liquidity"], 1).otherwise(0), None)]
    if model == "volume_sensitive":
        return [(0, F.floor(p["recent_volume"] * 0.25).cast("double")), (1, None)]
    if model == "competition":
        return [(0, F.floor(p.get("visible", F.lit(1000.0)) * p.get("factor", 0.3)).cast("double"))]
    raise ValueError(f"no such fill model: {model}")


def fills(side: Column, qty: Column, bid: Column, ask: Column, tick: float, tiers: list) -> tuple[Column, Column]:
    """Filled quantity and its average price (null if nothing fills) of a marketable order against tiers."""
    best, sign = F.when(side == 1, ask).otherwise(bid), F.when(side == 1, 1).otherwise(-1)
    left, got, cost = qty, F.lit(0.0), F.lit(0.0)
    for ticks, size in tiers:
        take = left if size is None else F.least(left, size if isinstance(size, Column) else F.lit(size))
        got, cost, left = got + take, cost + take * (best + sign * ticks * tick), left - take
    return got, F.when(got > 0, cost / got)


def delayed(ts: Column, kind: Column, base: int = 0, insert: int = 0, update: int = 0, cancel: int = 0) -> Column:
    """When a command reaches the venue: its time, the base latency, and that of its kind (ns)."""
    return ts + base + F.when(kind == "INSERT", insert).when(kind == "UPDATE", update).when(kind == "CANCEL", cancel).otherwise(0)


def reconciliation_price(qty: Column, px: Column, target_qty: Column, target_px: Column) -> Column:
    """The price of a fill that moves a position to its target; null where none does."""
    diff = target_qty - qty
    flat, flips = qty == 0, F.signum(qty) * F.signum(target_qty) < 0
    blended = (target_qty * target_px - qty * px) / diff
    px_ = F.when(flat | flips, target_px).when(target_qty == 0, px).otherwise(blended)
    return F.when((diff != 0) & (px_ > 0), px_)


def would_reduce_only(side: Column, leaves: Column, signed_qty: Column) -> Column:
    """Whether an order can only make the position smaller."""
    return F.when(side == 1, (signed_qty < 0) & (leaves <= -signed_qty)).otherwise((signed_qty > 0) & (leaves <= signed_qty))
