"""Concentrated-liquidity pools: exact integer maths, and a pool's state as a fold over its events.

Square-root prices are integers scaled by 2**96, as on chain; they pass 38 digits, so columns carry
them as decimal text and Python integers do the arithmetic.
"""

from __future__ import annotations

from bisect import bisect_right, insort

Q96 = 1 << 96
MIN_TICK, MAX_TICK = -887_272, 887_272


def mul_div(a: int, b: int, d: int, up: bool = False) -> int:
    """a * b / d, rounded down or up, without overflow."""
    q, r = divmod(a * b, d)
    return q + (1 if up and r else 0)


#: 1.0001 ** -(2**k / 2) scaled by 2**128, for k = 0 to 19, as the chain holds them.
_POWERS = (
    0xFFFCB933BD6FAD37AA2D162D1A594001,
    0xFFF97272373D413259A46990580E213A,
    0xFFF2E50F5F656932EF12357CF3C7FDCC,
    0xFFE5CACA7E10E4E61C3624EAA0941CD0,
    0xFFCB9843D60F6159C9DB58835C926644,
    0xFF973B41FA98C081472E6896DFB254C0,
    0xFF2EA16466C96A3843EC78B326B52861,
    0xFE5DEE046A99A2A811C461F1969C3053,
    0xFCBE86C7900A88AEDCFFC83B479AA3A4,
    0xF987A7253AC413176F2B074CF7815E54,
    0xF3392B0822B70005940C7A398E4B70F3,
    0xE7159475A2C29B7443B29C7FA6E889D9,
    0xD097F3BDFD2022B8845AD8F792AA5825,
    0xA9F746462D870FDF8A65DC1F90E061E5,
    0x70D869A156D2A1B890BB3DF62BAF32F7,
    0x31BE135F97D08FD981231505542FCFA6,
    0x9AA508B5B7A84E1C677DE54F3E99BC9,
    0x5D6AF8DEDB81196699C329225EE604,
    0x2216E584F5FA1EA926041BEDFE98,
    0x48A170391F7DC42444E8FA2,
)


def sqrt_price_at(tick: int) -> int:
    """Square root of 1.0001**tick, scaled by 2**96, in the chain's own fixed-point steps, rounded up."""
    if not MIN_TICK <= tick <= MAX_TICK:
        raise ValueError(f"tick {tick} is out of range")
    ratio = 1 << 128
    for k, power in enumerate(_POWERS):
        if abs(tick) >> k & 1:
            ratio = ratio * power >> 128
    if tick > 0:
        ratio = ((1 << 256) - 1) // ratio
    return -(-ratio >> 32)


def tick_at(sqrt_price: int) -> int:
    """The largest tick whose square-root price is at most this one."""
    low, high = MIN_TICK, MAX_TICK
    while low < high:
        mid = (low + high + 1) // 2
        if sqrt_price_at(mid) <= sqrt_price:
            low = mid
        else:
            high = mid - 1
    return low


def amount0(a: int, b: int, liquidity: int, up: bool) -> int:
    """Token 0 between two square-root prices."""
    a, b = sorted((a, b))
    x = mul_div(liquidity << 96, b - a, b, up)
    return -(-x // a) if up else x // a


def amount1(a: int, b: int, liquidity: int, up: bool) -> int:
    """Token 1 between two square-root prices."""
    return mul_div(liquidity, abs(b - a), Q96, up)


def next_price(price: int, liquidity: int, amount: int, zero_for_one: bool) -> int:
    """Square-root price after an input, rounded against the trader."""
    if zero_for_one:
        top = liquidity << 96
        return mul_div(top, price, top + amount * price, True)
    return price + (amount << 96) // liquidity


class Pool:
    """Swaps, mints, burns and flash loans of one pool; any other kind is an error. Rows: (kind, tick_lower, tick_upper, liquidity, amount_in, zero_for_one).

    Emits price, tick, active liquidity, amounts in and out, and the fee.
    """

    def __init__(self, price: int, fee_ppm: int = 3000):
        self.price, self.fee, self.tick, self.liquidity = price, fee_ppm, tick_at(price), 0
        self.net: dict[int, int] = {}
        self.gross: dict[int, int] = {}
        self.ticks: list[int] = []

    def position(self, lower: int, upper: int, delta: int) -> tuple[int, int]:
        """Adds (or, negative, takes) liquidity; token amounts in (negative: out)."""
        for t, sign in ((lower, 1), (upper, -1)):
            if t not in self.net:
                insort(self.ticks, t)
            self.net[t] = self.net.get(t, 0) + sign * delta
            self.gross[t] = self.gross.get(t, 0) + delta
            if not self.gross[t]:
                del self.net[t], self.gross[t]
                self.ticks.remove(t)
        if lower <= self.tick < upper:
            self.liquidity += delta
        a, b = sqrt_price_at(lower), sqrt_price_at(upper)
        p, up, n = min(max(self.price, a), b), delta > 0, abs(delta)
        x, y = amount0(p, b, n, up) if p < b else 0, amount1(a, p, n, up) if p > a else 0
        return (x, y) if up else (-x, -y)

    def swap(self, amount: int, zero_for_one: bool) -> tuple[int, int, int]:
        """Exact input through as many ticks as it takes; (in, out, fee). What finds no liquidity is not taken."""
        left, out, fees = amount, 0, 0
        while left > 0:
            nth = bisect_right(self.ticks, self.tick) - zero_for_one
            if not 0 <= nth < len(self.ticks):
                break
            edge = self.ticks[nth]
            goal = sqrt_price_at(edge)
            if self.liquidity:
                usable = left * (1_000_000 - self.fee) // 1_000_000
                need = amount0(goal, self.price, self.liquidity, True) if zero_for_one else amount1(self.price, goal, self.liquidity, True)
                full = usable >= need
                new = goal if full else next_price(self.price, self.liquidity, usable, zero_for_one)
                taken = need if full else (amount0(new, self.price, self.liquidity, True) if zero_for_one else amount1(self.price, new, self.liquidity, True))
                out += amount1(new, self.price, self.liquidity, False) if zero_for_one else amount0(self.price, new, self.liquidity, False)
                fee = mul_div(taken, self.fee, 1_000_000 - self.fee, True) if full else left - taken
                left -= taken + fee
                fees += fee
                self.price = new
            else:
                full, self.price = True, goal
            if not full:
                self.tick = tick_at(self.price)
                break
            self.liquidity += -self.net[edge] if zero_for_one else self.net[edge]
            self.tick = edge - 1 if zero_for_one else edge
        return amount - left, out, fees

    def flash(self, amount: int) -> int:
        """The fee of a loan that is paid back at once, rounded up; price and liquidity stay."""
        if not self.liquidity:
            raise ValueError("a flash loan needs active liquidity")
        return mul_div(amount, self.fee, 1_000_000, True)

    def step(self, row):
        kind, lower, upper, liquidity, amount, zero_for_one = row
        fee = 0
        if kind == "swap":
            paid, got, fee = self.swap(int(amount), bool(zero_for_one))
        elif kind in ("mint", "burn"):
            paid, got = self.position(lower, upper, int(liquidity) if kind == "mint" else -int(liquidity))
        elif kind == "flash":
            got, fee = int(amount), self.flash(int(amount))
            paid = got + fee
        else:
            raise ValueError(f"pool events of kind {kind!r} are not built")
        return [(str(self.price), self.tick, str(self.liquidity), str(paid), str(got), str(fee))]


POOL_DDL = "sqrt_price string, tick long, liquidity string, amount_in string, amount_out string, fee string"


def utilisation(active: int, total: int) -> float:
    """Share of all liquidity that the present price uses."""
    return active / total if total else 0.0
