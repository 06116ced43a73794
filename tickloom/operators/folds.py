"""Order-dependent recurrences: one ``step`` each, three drivers (batch, stream, plain Python).

A fold is an object whose ``step(row)`` takes a row's inputs (a tuple) and returns the rows it
emits (a list of tuples). Its attributes are its state, so it pickles for the streaming driver.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold(df: DataFrame, make: Callable[[], object], keys: list[str], order: list[str], inputs: list[str], outputs: str) -> DataFrame:
    """Batch driver: rows are dealt by key and sorted (both spill), then streamed through the fold.

    State is one fold object at a time, never a key's rows, so a hot key needs no more memory than
    another. ``outputs``: DDL of what ``step`` emits; keys and order columns come first.
    """
    if not order:
        raise ValueError("a total order is needed")
    carried = [*keys, *[o for o in order if o not in keys]]
    schema = T.StructType([df.schema[c] for c in carried] + list(T.StructType.fromDDL(outputs).fields))
    names = [f.name for f in schema.fields]
    columns = [*carried, *inputs]

    def run(batches):
        now, machine = None, None
        arrow = None
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for row in zip(*cols, strict=True):
                key = row[: len(keys)]
                if key != now or machine is None:
                    now, machine = key, make()
                head = row[: len(carried)]
                out += [head + tuple(o) for o in machine.step(row[len(carried) :])]
            if out:
                if arrow is None:
                    from pyspark.sql.pandas.types import to_arrow_schema

                    arrow = to_arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], names=names)

    picked = df.selectExpr(*[f"`{c}` AS c{i}" for i, c in enumerate(columns)])
    dealt = picked.repartition(*[f"c{i}" for i in range(len(keys))]).sortWithinPartitions(*[f"c{i}" for i in range(len(carried))])
    return dealt.mapInArrow(run, schema)


class Ema:
    """Seeded with the first value; alpha = 2 / (n + 1), or 1 / n (Wilder)."""

    def __init__(self, n: int, wilder: bool = False):
        self.n, self.alpha, self.value, self.count = n, 1 / n if wilder else 2 / (n + 1), None, 0

    def update(self, x: float) -> float:
        self.count += 1
        self.value = x if self.value is None else self.alpha * x + (1 - self.alpha) * self.value
        return self.value

    @property
    def ready(self) -> bool:
        return self.count >= self.n

    def step(self, row):
        return [(self.update(row[0]), self.ready)]


class Sma:
    def __init__(self, n: int):
        self.n, self.values = n, deque(maxlen=n)

    def update(self, x: float) -> float:
        self.values.append(x)
        return math.fsum(self.values) / len(self.values)

    @property
    def ready(self) -> bool:
        return len(self.values) >= self.n

    @property
    def value(self) -> float:
        return math.fsum(self.values) / len(self.values) if self.values else 0.0


def average(n: int, kind: str):
    return {"ema": lambda: Ema(n), "wilder": lambda: Ema(n, True), "sma": lambda: Sma(n)}[kind]()


class Dema:
    """2 EMA - EMA of EMA."""

    def __init__(self, n: int):
        self.n, self.one, self.two = n, Ema(n), Ema(n)

    def step(self, row):
        a = self.one.update(row[0])
        return [(2 * a - self.two.update(a), self.two.ready)]


class EfficiencyRatio:
    def __init__(self, n: int):
        self.inputs, self.deltas = deque(maxlen=n), deque(maxlen=n)

    def update(self, x: float) -> float:
        self.inputs.append(x)
        if len(self.inputs) < 2 and not self.deltas:
            return 0.0
        if len(self.inputs) > 1:
            self.deltas.append(abs(self.inputs[-1] - self.inputs[-2]))
        path = sum(self.deltas)
        return abs(self.inputs[-1] - self.inputs[0]) / path if path > 0 else 0.0


class Ama:
    """Adaptive: the efficiency ratio moves the smoothing between the fast and the slow constant."""

    def __init__(self, n: int, fast: int, slow: int):
        self.n, self.fast, self.slow = n, 2 / (fast + 1), 2 / (slow + 1)
        self.er, self.value, self.count = EfficiencyRatio(n), None, 0

    def step(self, row):
        x = row[0]
        self.count += 1
        er = self.er.update(x)
        if self.value is None:
            self.value = x
        else:
            sc = (er * (self.fast - self.slow) + self.slow) ** 2
            self.value += sc * (x - self.value)
        return [(self.value, self.count >= self.n)]


class Gains:
    """Averages of gains and losses; both see every row (the first one a change of 0)."""

    def __init__(self, n: int, kind: str):
        self.up, self.down, self.last = average(n, kind), average(n, kind), None

    def update(self, x: float) -> tuple[float, float]:
        d = 0.0 if self.last is None else x - self.last
        self.last = x
        return self.up.update(max(d, 0.0)), self.down.update(max(-d, 0.0))


class Rsi:
    """Relative strength in 0..1; 1 while the average loss is 0."""

    def __init__(self, n: int, kind: str = "ema"):
        self.gains = Gains(n, kind)

    def step(self, row):
        up, down = self.gains.update(row[0])
        return [(1.0 if down == 0 else 1 - 1 / (1 + up / down), self.gains.up.ready)]


class Cmo:
    """100 (G - L) / (G + L); 0 until warm, and where both are 0."""

    def __init__(self, n: int, kind: str = "wilder"):
        self.gains, self.value = Gains(n, kind), 0.0

    def update(self, x: float) -> float:
        up, down = self.gains.update(x)
        if self.gains.up.ready:
            self.value = 100 * (up - down) / (up + down) if up + down else 0.0
        return self.value

    @property
    def ready(self) -> bool:
        return self.gains.up.ready

    def step(self, row):
        return [(self.update(row[0]), self.ready)]


class Vidya:
    """k = alpha |CMO / 100|; starts from 0 once the CMO (of SMAs) is warm."""

    def __init__(self, n: int, kind: str = "sma"):
        self.alpha, self.cmo, self.value, self.ready = 2 / (n + 1), Cmo(n, kind), 0.0, False

    def step(self, row):
        k = self.alpha * abs(self.cmo.update(row[0]) / 100)
        if self.ready:
            self.value = k * row[0] + (1 - k) * self.value
        elif self.cmo.ready:
            self.ready = True
        return [(self.value, self.ready)]


class Directional:
    """Averages of upward and downward movement of highs and lows."""

    def __init__(self, n: int, kind: str = "ema"):
        self.up, self.down, self.last = average(n, kind), average(n, kind), None

    def step(self, row):
        high, low = row
        h, lo = self.last or row
        self.last = row
        a, b = high - h, lo - low
        return [(self.up.update(a if a > b and a > 0 else 0.0), self.down.update(b if b > a and b > 0 else 0.0), self.down.ready)]


class Macd:
    def __init__(self, fast: int, slow: int, kind: str = "ema"):
        self.fast, self.slow = average(fast, kind), average(slow, kind)

    def step(self, row):
        return [(self.fast.update(row[0]) - self.slow.update(row[0]), self.slow.ready)]


class Pressure:
    """Buying less selling pressure in ATRs, by relative volume, and its sum; inputs high, low, close, volume."""

    def __init__(self, n: int, kind: str = "ema", floor: float = 0.0):
        self.range, self.volume, self.floor, self.close, self.total = average(n, kind), average(n, kind), floor, None, 0.0

    def step(self, row):
        high, low, close, volume = row
        before = close if self.close is None else self.close
        self.close = close
        atr = max(self.floor, self.range.update(max(before, high) - min(low, before)))
        mean = self.volume.update(volume)
        value = 0.0 if atr == 0 or mean == 0 else ((close - low) - (high - close)) / atr * volume / mean
        self.total += value
        return [(value, self.total, self.range.ready)]


class Renko:
    """Bricks of a fixed size; inputs price, size. Every brick of a move carries the volume gathered since the last one."""

    def __init__(self, brick: float):
        self.brick, self.close, self.volume = brick, None, 0.0

    def step(self, row):
        price, size = row
        self.volume += size
        if self.close is None:
            self.close = price
            return []
        units = round((price - self.close) / self.brick, 9)
        n = int(abs(units))
        out = []
        for _ in range(n):
            start = self.close
            self.close = round(start + math.copysign(self.brick, units), 9)
            out.append((start, max(start, self.close), min(start, self.close), self.close, self.volume))
        if n:
            self.volume = 0.0
        return out


class Position:
    """Fills (side, qty, px, commission) to a position. A fill that passes zero closes one position and opens the next.

    Emits signed quantity, average open price, average close price, realised PnL and return of the
    position, its number, its largest quantity, and the realised PnL of all positions.
    """

    def __init__(self, multiplier: float = 1.0, inverse: bool = False):
        self.multiplier, self.inverse = multiplier, inverse
        self.qty = self.open = self.close = self.closed = self.pnl = self.ret = self.peak = self.total = 0.0
        self.episode = 0

    def points(self, open_px: float, close_px: float) -> float:
        sign = 1.0 if self.qty > 0 else -1.0
        if not self.inverse:
            return sign * (close_px - open_px)
        if abs(open_px) < 1e-15 or abs(close_px) < 1e-15:
            return 0.0
        return sign * (1 / open_px - 1 / close_px)

    def _apply(self, side: int, qty: float, px: float, fee: float) -> None:
        if self.qty == 0:
            self.episode += 1
            self.open, self.close, self.closed, self.pnl, self.ret, self.peak = px, 0.0, 0.0, 0.0, 0.0, 0.0
        gain = -fee
        if self.qty and (self.qty > 0) != (side > 0):
            self.close = (self.close * self.closed + px * qty) / (self.closed + qty)
            self.closed += qty
            sign = 1.0 if self.qty > 0 else -1.0
            self.ret = sign * (self.close - self.open) / self.open if self.open else 0.0
            gain += qty * self.multiplier * self.points(self.open, px)
        elif self.qty:
            self.open = (self.open * abs(self.qty) + px * qty) / (abs(self.qty) + qty)
        self.pnl += gain
        self.total += gain
        self.qty = round(self.qty + side * qty, 9)
        self.peak = max(self.peak, abs(self.qty))

    def step(self, row):
        side, qty, px, fee = row
        held = abs(self.qty)
        if held and (self.qty > 0) != (side > 0) and qty > held:
            self._apply(side, held, px, fee * held / qty)
            self._apply(side, qty - held, px, fee * (qty - held) / qty)
        else:
            self._apply(side, qty, px, fee)
        return [(self.qty, self.open, self.close, self.pnl, self.ret, self.episode, self.peak, self.total)]


POSITION_DDL = "signed_qty double, avg_px_open double, avg_px_close double, realized_pnl double, realized_return double, episode long, peak_qty double, total_pnl double"


class BetPosition:
    """Bets (back 1 or lay -1, price, stake): the price is that of the opening bet; opposite bets close exposure."""

    def __init__(self):
        self.price = self.exposure = self.pnl = 0.0

    def step(self, row):
        side, price, stake = row
        exposure = side * price * stake
        if self.exposure == 0 or (self.exposure > 0) == (exposure > 0):
            if self.exposure == 0:
                self.price = price
            self.exposure += exposure
        else:
            closing = min(abs(exposure), abs(self.exposure))
            part = closing / price  # stake of the closing part
            opened = closing / self.price
            self.pnl += (part - opened) * (1 if side < 0 else -1)
            rest = abs(exposure) - closing
            self.exposure += (closing if side > 0 else -closing)
            if rest > 1e-12:
                self.price, self.exposure = price, side * rest
            elif abs(self.exposure) < 1e-12:
                self.price = self.exposure = 0.0
        return [(self.price, self.exposure, self.pnl)]


class TrailingStop:
    """Highest price less an offset, for a long position (side 1), or lowest plus one (side -1); never loosens."""

    def __init__(self, side: int, offset: float, kind: str = "price", tick: float = 0.01):
        self.side, self.offset, self.kind, self.tick, self.stop = side, offset, kind, tick, None

    def step(self, row):
        px = row[0]
        off = {"price": self.offset, "basis_points": px * self.offset / 10_000, "ticks": self.offset * self.tick}[self.kind]
        want = px - self.side * off
        if self.stop is None or self.side * (want - self.stop) > 0:
            self.stop = want
        return [(self.stop, self.side * (px - self.stop) <= 0)]
