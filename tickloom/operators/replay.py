"""Merging, matching and simulating: streams in time order, triggers, fees, latency, rate limits, FX paths."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.folds import fold


def merged(streams: dict[str, DataFrame], append: dict[str, bool] | None = None) -> DataFrame:
    """One stream of several (ts, seq, ...) with ``type`` and ``priority``: appended streams come after others at the same time.

    The order is (ts, priority, seq); sort by it where rows are consumed, so that the sort is the consumer's range shuffle.
    """
    out = []
    for i, (name, df) in enumerate(streams.items()):
        p = (i + 1) * (1 if (append or {}).get(name, True) else -1)
        out.append(df.withColumn("type", F.lit(name)).withColumn("priority", F.lit(p)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


#: Rows that a task of ``first_triggers`` holds before it answers them (more only of one instrument and time).
HELD = 200_000


def _ordered(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles, as Spark has it: one zero, NaN above all."""
    bits = (values + 0.0).view(np.int64)
    bits = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return np.where(np.isnan(values), np.iinfo(np.int64).max, bits)


class Lows:
    """Minima of aligned blocks of 1, 2, 4, ... values, twice the values in all."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.rows = [np.append(values, np.full((1 << max(0, self.n - 1).bit_length()) - self.n, np.iinfo(np.int64).max))]
        while len(self.rows[-1]) > 1:
            self.rows.append(np.minimum(self.rows[-1][::2], self.rows[-1][1::2]))

    def first(self, start: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Places of the first values from ``start`` on that are at most the level; the number of values where there is none."""
        at, height, live = start.copy(), np.full(len(start), -1), start < self.n
        for k, row in enumerate(self.rows):  # up to a block that holds one
            todo = np.flatnonzero(live & ((at % 2 == 1) | (len(row) == 1)))
            found = row[at[todo]] <= level[todo]
            height[todo[found]] = k
            live[todo[found]] = False
            at[todo[~found]] += 1
            live &= at < len(row)
            at[live] //= 2
        for k in range(len(self.rows) - 1, 0, -1):  # and down to its first
            down = np.flatnonzero(height >= k)
            at[down] *= 2
            at[down] += self.rows[k - 1][at[down]] > level[down]
        return np.where(height >= 0, np.minimum(at, self.n), self.n)


def _records(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the values below all earlier ones of their group; ``first``: the place where each value's group begins."""
    out, begin = [], np.flatnonzero(first == np.arange(len(values)))
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(values)], strict=True):
        low = np.minimum.accumulate(values[a:b])
        out.append(a + np.flatnonzero(np.append(True, low[1:] < low[:-1])))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_ANSWER, _LOW, _HIGH, _FALLS, _RISES = range(5)


def first_triggers(orders: DataFrame, prices: DataFrame, bucket: int = 3600 * 10**9) -> DataFrame:
    """The first price after each order that triggers it: limit buy at or below, limit sell at or above; stops the other way.

    Prices and orders are dealt by instrument and time bucket and streamed in order of time in pieces of about ``HELD`` rows (the
    time of a piece's end is never cut). A piece answers its orders by a search in its prices' block minima. Of a piece's prices,
    those below (above) all before them in it decide for orders of earlier pieces, and only they meet the orders left, by
    instrument. No price meets an order in a join.
    """
    falls = F.coalesce((F.col("kind") == "LIMIT") == (F.col("side") == 1), F.lit(False))
    id_type, seq_type, name_type = (df.schema[c].dataType for df, c in ((orders, "order_id"), (prices, "seq"), (orders, "instrument")))
    none = lambda t: F.lit(None).cast(t)
    p = prices.select("instrument", "ts", F.lit(_LOW).alias("what"), "seq", F.col("price").cast("double").alias("px"), none(id_type).alias("order_id"))
    o = orders.select("instrument", "ts", F.when(falls, _FALLS).otherwise(_RISES).alias("what"), none(seq_type).alias("seq"), F.col("price").cast("double").alias("px"), "order_id")
    both = p.union(o).where("instrument IS NOT NULL AND ts IS NOT NULL AND px IS NOT NULL")
    both = both.repartition("instrument", F.expr(f"ts div {bucket}")).sortWithinPartitions("instrument", "ts", "what", "seq", "px")  # prices before the orders of their time
    schema = T.StructType([T.StructField("instrument", name_type), T.StructField("order_id", id_type), T.StructField("what", T.IntegerType()), T.StructField("ts", T.LongType()), T.StructField("place", T.LongType()), T.StructField("px", T.DoubleType())])

    def changes(*columns) -> np.ndarray:
        """Places at which a new run of equal rows begins."""
        new = np.zeros(columns[0].shape[0], bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    def codes(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def numbers(held: pa.Table, *names: str):
        return [held.column(n).to_numpy() for n in names]

    def made(held: pa.Table, rows: np.ndarray, what, ts, place, px) -> list[pa.RecordBatch]:
        n = len(rows)
        take = held.select(["instrument", "order_id"]).take(pa.array(rows))
        cols = [np.broadcast_to(x, n) for x in (what, ts, place, px)]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([*take.columns, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=schema.names).to_batches(10_000)

    def near(held: pa.Table) -> list[pa.RecordBatch]:
        """A piece: its orders' answers or, with the piece's last time, themselves, and its prices' records."""
        name, (ts, what, px) = codes(held.column("instrument")), numbers(held, "ts", "what", "px")
        begin = changes(name, np.where(ts < 0, -(-ts // bucket), ts // bucket))
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ts))))
        last = ts[np.append(begin[1:], len(ts)) - 1]
        is_price = what == _LOW
        at, before = np.flatnonzero(is_price), np.cumsum(is_price)
        end = before[np.append(begin[1:], len(ts)) - 1]
        value, order = _ordered(px), np.flatnonzero(~is_price)
        first = np.append(0, end[:-1])[group[at]]
        out = []
        for kind, sign, record in ((_FALLS, 0, _LOW), (_RISES, -1, _HIGH)):
            flipped = value ^ sign  # the other order: what rises to a level falls to it
            own = order[what[order] == kind]
            hit = Lows(flipped[at]).first(before[own], flipped[own])
            got = hit < end[group[own]]
            to = at[hit[got]]
            out += made(held, own[got], _ANSWER, ts[to], to, px[to])
            out += made(held, own[~got], kind, last[group[own[~got]]], 0, px[own[~got]])
            best = at[_records(flipped[at], first)]
            out += made(held, best, record, ts[best], best, px[best])
        return out

    def solve(batches):
        waiting, rows, limit = [], 0, HELD
        for batch in batches:
            waiting.append(batch)
            rows += len(batch)
            if rows < limit:
                continue
            held = pa.Table.from_batches(waiting)
            cut = int(changes(codes(held.column("instrument")), held.column("ts").to_numpy())[-1])
            if cut:
                yield from near(held.slice(0, cut))
            waiting, rows = held.slice(cut).to_batches(), len(held) - cut
            limit = max(HELD, 2 * rows)
        if rows:
            yield from near(pa.Table.from_batches(waiting))

    def far(batches):
        now, known, lows = None, {_LOW: [], _HIGH: []}, {}
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            begin = changes(codes(batch.column("instrument")), batch.column("what").to_numpy()).tolist()
            for a, b in zip(begin, [*begin[1:], len(batch)], strict=True):
                held = batch.slice(a, b - a)
                name, what = held.column("instrument")[0].as_py(), held.column("what")[0].as_py()
                if name != now:
                    now, known, lows = name, {_LOW: [], _HIGH: []}, {}
                ts, px = numbers(held, "ts", "px")
                if what in known:
                    known[what].append((ts, held.column("place").to_numpy(), px))
                    continue
                sign, record = (0, _LOW) if what == _FALLS else (-1, _HIGH)
                if record not in lows:
                    t, place, x = (np.concatenate(c) for c in zip(*known[record], strict=True)) if known[record] else (ts[:0], ts[:0], px[:0])
                    lows[record], known[record] = (t, place, x, Lows(_ordered(x) ^ sign)), []
                t, place, x, tree = lows[record]
                hit = tree.first(np.searchsorted(t, ts, side="right"), _ordered(px) ^ sign)
                got = np.flatnonzero(hit < len(t))
                yield from made(held, got, _ANSWER, t[hit[got]], place[hit[got]], x[hit[got]])

    # the exchange below is the same for both, so it is made once
    solved = both.mapInArrow(solve, schema)
    left = solved.where(F.col("what") != _ANSWER).repartition("instrument").sortWithinPartitions("instrument", "what", "ts", "place")
    found = solved.where(F.col("what") == _ANSWER).union(left.mapInArrow(far, schema))
    return found.groupBy("instrument", "order_id").agg(F.min("ts").alias("trigger_ts"), F.min_by("px", F.struct("ts", "place")).alias("trigger_px"))


class Throttle:
    """Sends a message unless ``limit`` were sent in the interval up to it; only what was sent counts."""

    def __init__(self, limit: int, interval: int):
        self.limit, self.interval, self.sent = limit, interval, []

    def step(self, row):
        (now,) = row
        self.sent = [t for t in self.sent if now - t < self.interval]
        allowed = len(self.sent) < self.limit
        if allowed:
            self.sent.append(now)
        return [(len(self.sent), allowed)]


def throttled(rows: DataFrame, limit: int, interval: int, key: str, order: list[str]) -> DataFrame:
    """Of each row (``order`` begins with ts) whether it is sent, and how many were sent in the interval up to and with it."""
    return fold(rows, lambda: Throttle(limit, interval), [key], order, ["ts"], "sent long, allowed boolean")


def exchange_rates(spark: SparkSession, quotes: list[tuple[str, str, float, float]], most_hops: int = 6) -> DataFrame:
    """Mid rates between all currencies that quotes (base, quote, bid, ask) connect: fewest hops, then the path's name.

    A pair's inverse counts as one hop. Currencies are few, so this is a breadth-first join of small tables.
    """
    rows = [(b, q, (x + y) / 2) for b, q, x, y in quotes] + [(q, b, 2 / (x + y)) for b, q, x, y in quotes]
    edges = spark.createDataFrame(rows, "f string, t string, r double")
    found = edges.select(F.col("f").alias("source"), F.col("t").alias("target"), F.concat_ws(">", "f", "t").alias("path"), F.col("r").alias("rate"), F.lit(1).alias("hops"), F.array("f", "t").alias("seen"))
    best = W.partitionBy("source", "target").orderBy("hops", "path")
    found = found.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    for _ in range(most_hops - 1):
        more = found.join(F.broadcast(edges), F.col("target") == F.col("f")).where(~F.array_contains("seen", F.col("t")))
        more = more.select("source", F.col("t").alias("target"), F.concat_ws(">", "path", "t").alias("path"), (F.col("rate") * F.col("r")).alias("rate"), (F.col("hops") + 1).alias("hops"), F.concat("seen", F.array("t")).alias("seen"))
        found = found.union(more).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    return found.drop("seen")


def spread_quotes(spine: DataFrame, legs: DataFrame) -> DataFrame:
    """Quotes of a spread at each spine time from its legs' latest (ratio, vega, bid, ask, sizes); outward to the tick.

    mid: sum of ratio times mid; width: |sum of ratio times vega| times the mean of |leg width / vega|.
    """
    mid = F.sum(F.col("ratio") * (F.col("bid") + F.col("ask")) / 2)
    ratio = F.when(F.col("vega") != 0, F.abs((F.col("ask") - F.col("bid")) / F.col("vega")))
    width = F.abs(F.sum(F.col("ratio") * F.col("vega"))) * F.avg(ratio)
    g = legs.groupBy("ts").agg(mid.alias("mid"), F.coalesce(width, F.lit(0.0)).alias("width"), F.min("bid_size").alias("bid_size"), F.min("ask_size").alias("ask_size"), F.first("tick").alias("tick"))
    g = g.withColumn("bid", F.floor(F.round((F.col("mid") - F.col("width") / 2) / F.col("tick"), 9)) * F.col("tick")).withColumn("ask", F.ceil(F.round((F.col("mid") + F.col("width") / 2) / F.col("tick"), 9)) * F.col("tick"))
    return spine.join(g, "ts").select("ts", "bid", "ask", "bid_size", "ask_size")
