"""Scalar pricing as Column expressions; SQL text forms are shared where both engines take the same words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximation of the normal distribution (Hart 5666, after West 2005); fixed values.
_UPPER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_LOWER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
DAY_SHARE = 1 / 365.25


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / 2.5066282746310002


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution, to 1e-14, without leaving the JVM."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * _horner(a, _UPPER) / _horner(a, _LOWER)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_cdf_sql(x: str) -> str:
    h = lambda cs: "".join("(" for _ in cs[1:]) + repr(cs[0]) + "".join(f" * abs({x}) + {c!r})" for c in cs[1:])
    near = f"exp(-({x}) * ({x}) / 2) * {h(_UPPER)} / {h(_LOWER)}"
    return f"(CASE WHEN {x} > 0 THEN 1 - {near} ELSE {near} END)"


def black_scholes(s: Column, r: Column, b: Column, vol: Column, call: Column, k: Column, t: Column, multiplier: Column | float = 1.0) -> dict[str, Column]:
    """price, delta, gamma, vega (a percent point), theta (a day); generalised with cost of carry b."""
    phi = F.when(call, 1.0).otherwise(-1.0)
    m = multiplier if isinstance(multiplier, Column) else F.lit(multiplier)
    sd = vol * F.sqrt(t)
    d1 = (F.log(s / k) + (b + 0.5 * vol * vol) * t) / sd
    d2 = d1 - sd
    c1, c2, pdf = norm_cdf(phi * d1), norm_cdf(phi * d2), norm_pdf(d1)
    df = F.exp((b - r) * t)
    st, kt = s * df, k * F.exp(-r * t)
    theta = st * (-pdf * vol / (2 * F.sqrt(t)) - phi * (b - r) * c1) - phi * r * kt * c2
    return {
        "price": m * phi * (st * c1 - kt * c2), "delta": m * phi * df * c1, "gamma": m * df * pdf / (s * sd),
        "vega": m * st * F.sqrt(t) * pdf * 0.01, "theta": m * theta * DAY_SHARE,
    }


def black_price_of(vol: Column, f: Column, k: Column, t: Column, call: Column) -> Column:
    """Undiscounted Black price on a forward."""
    phi = F.when(call, 1.0).otherwise(-1.0)
    sd = vol * F.sqrt(t)
    d1 = F.log(f / k) / sd + sd / 2
    return phi * (f * norm_cdf(phi * d1) - k * norm_cdf(phi * (d1 - sd)))


def _norm_cdf(x: np.ndarray) -> np.ndarray:
    """``norm_cdf`` of arrays."""
    a = np.abs(x)
    tail = np.exp(-a * a / 2) * np.polyval(_UPPER, a) / np.polyval(_LOWER, a)
    out = np.flatnonzero(a >= 7.07106781186547)
    if len(out):
        y = a[out]
        tail[out] = np.where(y > 37, 0.0, np.exp(-y * y / 2) / (y + 1 / (y + 2 / (y + 3 / (y + 4 / (y + 0.65))))) / 2.506628274631)
    return np.where(x > 0, 1 - tail, tail)


def _implied(want: np.ndarray, f: np.ndarray, k: np.ndarray, t: np.ndarray, call: np.ndarray, steps: int, most: float) -> np.ndarray:
    """Volatilities at which undiscounted Black prices are ``want``, by bisection of (1e-6, most)."""
    phi = np.where(call, 1.0, -1.0)
    root, log = np.sqrt(t), np.log(f / k)
    lo, hi = np.full(len(want), 1e-6), np.full(len(want), most)
    for _ in range(steps):
        mid = (lo + hi) / 2
        sd = mid * root
        d1 = log / sd + sd / 2
        low = phi * (f * _norm_cdf(phi * d1) - k * _norm_cdf(phi * (d1 - sd))) < want
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def implied_vol(price: Column, s: Column, r: Column, b: Column, call: Column, k: Column, t: Column, steps: int = 50, most: float = 5.0, plain_forward: bool = False) -> Column:
    """Black volatility by bisection, a batch of options at once in a Python worker; 0 if the price has none.

    The forward is s * exp(b t); ``plain_forward`` leaves t out.
    """
    f = s * F.exp(b if plain_forward else b * t)
    want = price * F.exp(r * t)

    @F.pandas_udf("double")
    def found(want: pd.Series, f: pd.Series, k: pd.Series, t: pd.Series, call: pd.Series) -> pd.Series:
        out = np.zeros(len(want))
        inner = np.maximum(np.where(call, f - k, k - f), 0.0)
        has = np.flatnonzero((want > inner) & (want < np.where(call, f, k)))
        with np.errstate(all="ignore"):
            for a in range(0, len(has), 4096):  # a batch's arrays stay in the cache
                at = has[a : a + 4096]
                out[at] = _implied(*(x.to_numpy()[at] for x in (want, f, k, t)), call.to_numpy()[at], steps, most)
        return pd.Series(out)

    got = [want.cast("double"), f.cast("double"), k.cast("double"), t.cast("double"), F.coalesce(call, F.lit(False))]
    return found(*got)


def modified_greeks(delta: Column, gamma: Column, s: Column, beta: Column | None = None, index: Column | None = None, percent: bool = False) -> dict[str, Column]:
    """Delta and gamma against an index (beta-weighted) and, with ``percent``, for a move of one percent."""
    if beta is not None:
        factor = beta * s / index
        delta, gamma, s = delta * factor, gamma * factor * factor, index
    if percent:
        delta, gamma = delta * s / 100, gamma * (s / 100) * (s / 100)
    return {"delta": delta, "gamma": gamma}


def curve_rate(t: Column, tenors: list[float], rates: list[float]) -> Column:
    """Quadratic interpolation, two parabolas blended linearly between inner tenors; flat beyond the ends."""
    n = len(tenors)
    if n == 1:
        return F.lit(rates[0])
    if n == 2:
        mid = rates[0] + (t - tenors[0]) * (rates[1] - rates[0]) / (tenors[1] - tenors[0])
        return F.when(t <= tenors[0], rates[0]).when(t >= tenors[1], rates[1]).otherwise(mid)

    def through(i: int) -> Column:
        x, y = tenors[i : i + 3], rates[i : i + 3]
        total = F.lit(0.0)
        for a in range(3):
            b, c = [j for j in range(3) if j != a]
            total = total + y[a] * (t - x[b]) * (t - x[c]) / ((x[a] - x[b]) * (x[a] - x[c]))
        return total

    out = F.when(t <= tenors[0], rates[0]).when(t >= tenors[-1], rates[-1])
    for i in range(n - 1):
        if i == 0:
            y = through(0)
        elif i == n - 2:
            y = through(n - 3)
        else:
            w = (tenors[i + 1] - t) / (tenors[i + 1] - tenors[i])
            y = w * through(i - 1) + (1 - w) * through(i)
        out = out.when(t <= tenors[i + 1], y)
    return out


def notional(qty: Column, price: Column, multiplier: Column, inverse: Column, quanto: Column | None = None) -> Column:
    """Linear (and quanto): quantity times multiplier times price; inverse: over price."""
    return F.when(inverse, qty * multiplier / price).otherwise(qty * multiplier * price)


def commission(notional_: Column, maker: Column, maker_rate: Column, taker_rate: Column) -> Column:
    return notional_ * F.when(maker, maker_rate).otherwise(taker_rate)


def margin(notional_: Column, rate: Column, leverage: Column, leveraged: bool = True) -> Column:
    """Initial or maintenance margin; the standard model leaves leverage out."""
    return notional_ / leverage * rate if leveraged else notional_ * rate


def unrealized(signed_qty: Column, open_px: Column, price: Column, multiplier: Column | float = 1.0) -> Column:
    return signed_qty * (price - open_px) * multiplier


def fixed_risk_size(entry: Column, stop: Column, equity: Column, risk: float, commission_rate: float, step: float, rate: Column | float = 1.0, most: float | None = None) -> Column:
    """Size whose loss at the stop is ``risk`` of equity, less commissions both ways, floored to a step; 0 for no distance."""
    money = equity * risk
    riskable = money - money * commission_rate * 2
    size = riskable / rate / F.abs(entry - stop)
    size = F.floor(F.when(F.abs(entry - stop) > 0, size).otherwise(0.0) / step) * step
    return F.greatest(F.least(size, F.lit(most)) if most is not None else size, F.lit(0.0))


def bet(side: Column, price: Column, stake: Column) -> dict[str, Column]:
    """Back (1) or lay (-1): exposure, liability, profit, payoffs if it wins and loses."""
    back = side == 1
    gain = stake * (price - 1)
    return {
        "exposure": F.when(back, price * stake).otherwise(-price * stake), "liability": F.when(back, stake).otherwise(gain),
        "profit": F.when(back, gain).otherwise(stake), "win_payoff": F.when(back, gain).otherwise(-gain), "lose_payoff": F.when(back, -stake).otherwise(stake),
    }


def hedging_stake(price: Column, stake: Column, now: Column) -> Column:
    """Stake of the opposite bet at today's price that evens both outcomes."""
    return stake * price / now


def tick_price(price: Column, tick: float, side: str, n: int = 0) -> Column:
    """n ticks below (bid) or above (ask) the price's own tick."""
    units = F.round(price / tick, 9)
    return (F.floor(units) - n) * tick if side == "bid" else (F.ceil(units) + n) * tick


def overnight_rate(base: Column, quote: Column) -> Column:
    """Daily rollover rate of a pair from yearly rates in percent."""
    return (base - quote) / 365 / 100
