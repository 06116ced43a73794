"""Indicators that are pure window expressions. Each takes bars (instrument, ts, open, high, low, close, volume)
and adds its columns; ``ready`` tells whether the warm-up is over. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.windows import Series

BARS = Series("instrument", "ts")


def _ready(df: DataFrame, n: int, s: Series = BARS) -> DataFrame:
    return df.withColumn("ready", s.number() >= n)


def sma(df: DataFrame, n: int, price: str = "close", s: Series = BARS) -> DataFrame:
    """Mean of the last n or fewer."""
    return _ready(df.withColumn("sma", s.mean(price, n)), n, s)


def _weighted(price: str, weights: list[float], s: Series) -> Column:
    """The newest value has the last weight; fewer values use the last weights."""
    n = len(weights)
    lags = [(F.col(price) if k == 0 else s.lag(price, k), weights[n - 1 - k]) for k in range(n)]
    top = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in lags), F.lit(0.0))
    bottom = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in lags), F.lit(0.0))
    return top / bottom


def wma(df: DataFrame, weights: list[float], price: str = "close", s: Series = BARS) -> DataFrame:
    return _ready(df.withColumn("wma", _weighted(price, weights, s)), len(weights), s)


def hma(df: DataFrame, n: int, price: str = "close", s: Series = BARS) -> DataFrame:
    """WMA(sqrt n) of 2 WMA(n / 2) - WMA(n), linear weights."""
    ramp = lambda k: [float(i + 1) for i in range(k)]
    df = df.withColumn("_x", 2 * _weighted(price, ramp(max(1, n // 2)), s) - _weighted(price, ramp(n), s))
    return _ready(df.withColumn("hma", _weighted("_x", ramp(max(1, int(n**0.5))), s)), n, s).drop("_x")


def vwap(df: DataFrame, day_ns: int = 86400 * 10**9) -> DataFrame:
    """Volume-weighted typical price since the start of the UTC day; without volume yet, the day's first price."""
    s = Series(["instrument", "_day"], "ts")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("_day", F.expr(f"ts div {day_ns}")).withColumn("_p", typical)
    value = F.sum(F.col("_p") * F.col("volume")).over(s.all)
    total = F.sum("volume").over(s.all)
    return df.withColumn("vwap", F.when(total > 0, value / total).otherwise(F.first("_p").over(s.all))).drop("_day", "_p")


def linear_regression(df: DataFrame, n: int, price: str = "close") -> DataFrame:
    """Least squares over the last n (x from 1 to n): slope, intercept, value, degree, cfo, r2; null until full."""
    w = BARS.last(n)
    df = df.withColumn("_i", BARS.number().cast("double")).withColumn("_y", F.col(price))
    df = df.withColumn("slope", F.regr_slope("_y", "_i").over(w)).withColumn("_mean", F.avg("_y").over(w)).withColumn("r2", F.regr_r2("_y", "_i").over(w))
    df = df.withColumn("intercept", F.col("_mean") - F.col("slope") * (n + 1) / 2).withColumn("value", F.col("intercept") + F.col("slope") * n)
    df = df.withColumn("degree", F.degrees(F.atan("slope"))).withColumn("cfo", 100 * (F.col("value") - F.col("_y")) / F.col("_y"))
    df = _ready(df, n)
    for c in ("slope", "intercept", "value", "degree", "cfo", "r2"):
        df = df.withColumn(c, F.when(F.col("ready"), F.col(c)))
    return df.drop("_i", "_y", "_mean")


def efficiency_ratio(df: DataFrame, n: int, price: str = "close") -> DataFrame:
    """|newest - oldest of n| over the sum of the last n absolute changes; 0 if that is 0."""
    df = df.withColumn("_d", F.abs(F.col(price) - BARS.lag(price)))
    net = F.abs(F.col(price) - F.first(price).over(BARS.last(n)))
    path = F.sum("_d").over(BARS.last(n))
    return _ready(df.withColumn("er", F.when(path > 0, net / path).otherwise(0.0)), n).drop("_d")


def spread_analyzer(quotes: DataFrame, n: int) -> DataFrame:
    s = Series("instrument", "ts", "seq")
    q = quotes.withColumn("spread", F.col("ask") - F.col("bid"))
    return _ready(q.withColumn("mean_spread", s.mean("spread", n)), n, s)


def roc(df: DataFrame, n: int, log: bool = False, price: str = "close") -> DataFrame:
    """Change against the oldest of the last n, or its natural logarithm."""
    first = F.first(price).over(BARS.last(n))
    return _ready(df.withColumn("roc", F.log(F.col(price) / first) if log else (F.col(price) - first) / first), n)


def stochastics(df: DataFrame, k: int, d: int) -> DataFrame:
    """%K and %D (of summed ranges); both hold where the range is 0."""
    hh, ll = F.max("high").over(BARS.last(k)), F.min("low").over(BARS.last(k))
    df = df.withColumn("_up", F.col("close") - ll).withColumn("_range", hh - ll)
    live = F.col("_range") > 0
    df = df.withColumn("_k", F.when(live, 100 * F.col("_up") / F.col("_range")))
    df = df.withColumn("_n", F.sum(F.when(live, 1).otherwise(0)).over(BARS.all))
    # %D sums the last d rows that had a range
    inside = Series(["instrument", "_live"], "ts")
    df = df.withColumn("_live", live)
    top, bottom = F.sum("_up").over(inside.last(d)), F.sum("_range").over(inside.last(d))
    df = df.withColumn("_d", F.when(live, 100 * top / bottom))
    out = df.withColumn("k", F.coalesce(BARS.held("_k"), F.lit(0.0))).withColumn("d", F.coalesce(BARS.held("_d"), F.lit(0.0)))
    return _ready(out, k).drop("_up", "_range", "_k", "_n", "_live", "_d")


def typical(df: DataFrame) -> DataFrame:
    return df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)


def cci(df: DataFrame, n: int, scalar: float = 0.015) -> DataFrame:
    """(tp - mean) / (scalar * mean absolute deviation); holds where that is 0."""
    w = BARS.last(n)
    df = typical(df).withColumn("_m", F.avg("_tp").over(w)).withColumn("_all", F.collect_list("_tp").over(w))
    mad = F.aggregate("_all", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_m"))) / F.size("_all")
    df = df.withColumn("_mad", mad).withColumn("_v", F.when(F.col("_mad") > 1e-12, (F.col("_tp") - F.col("_m")) / (scalar * F.col("_mad"))))
    return _ready(df.withColumn("cci", F.coalesce(BARS.held("_v"), F.lit(0.0))), n).drop("_tp", "_m", "_all", "_mad", "_v")


def macd_sma(df: DataFrame, fast: int, slow: int, price: str = "close") -> DataFrame:
    return _ready(df.withColumn("macd", BARS.mean(price, fast) - BARS.mean(price, slow)), slow)


def bollinger(df: DataFrame, n: int, k: float) -> DataFrame:
    """Mean of the typical price, and k population deviations each side."""
    df = typical(df).withColumn("middle", BARS.mean("_tp", n)).withColumn("_sd", F.stddev_pop("_tp").over(BARS.last(n)))
    return _ready(df.withColumn("upper", F.col("middle") + k * F.col("_sd")).withColumn("lower", F.col("middle") - k * F.col("_sd")), n).drop("_tp", "_sd")


def aroon(df: DataFrame, n: int) -> DataFrame:
    """Bars since the highest high and lowest low of the last n + 1; the newest wins a tie."""
    w = BARS.last(n + 1)
    df = df.withColumn("_i", BARS.number())
    up = F.max_by("_i", F.struct("high", "_i")).over(w)
    down = F.max_by("_i", F.struct(-F.col("low"), F.col("_i"))).over(w)
    df = df.withColumn("up", 100 * (1 - (F.col("_i") - up) / n)).withColumn("down", 100 * (1 - (F.col("_i") - down) / n))
    return _ready(df.withColumn("aroon", F.col("up") - F.col("down")), n + 1).drop("_i")


def amat(df: DataFrame, fast: int, slow: int, signal: int, price: str = "close") -> DataFrame:
    """Trend flags of two SMAs over the last signal + 1 values that the slow one has had since it was full."""
    df = df.withColumn("_f", BARS.mean(price, fast)).withColumn("_s", BARS.mean(price, slow)).withColumn("_on", BARS.number() >= slow)
    inside = Series(["instrument", "_on"], "ts")
    df_ = F.col("_f") - F.first("_f").over(inside.last(signal + 1))
    ds = F.col("_s") - F.first("_s").over(inside.last(signal + 1))
    df = df.withColumn("_df", df_).withColumn("_ds", ds)
    flat = F.abs("_ds") < 1e-12
    long = F.col("_on") & (F.col("_df") > 1e-12) & ~flat
    short = F.col("_on") & (F.col("_df") < -1e-12) & ~flat
    return _ready(df.withColumn("long_run", long).withColumn("short_run", short), slow + signal).drop("_f", "_s", "_on", "_df", "_ds")


def bias(df: DataFrame, n: int, price: str = "close") -> DataFrame:
    return _ready(df.withColumn("bias", F.col(price) / BARS.mean(price, n) - 1), n)


def vhf(df: DataFrame, n: int, price: str = "close") -> DataFrame:
    """|highest - lowest| / n / mean |change|, from the row after the warm-up on; 0 before."""
    df = df.withColumn("_d", F.abs(F.col(price) - F.coalesce(BARS.lag(price), price)))
    w = BARS.last(n)
    value = (F.max(price).over(w) - F.min(price).over(w)) / n / F.avg("_d").over(w)
    df = _ready(df.withColumn("_v", value), n)
    return df.withColumn("vhf", F.when(BARS.number() > n, F.col("_v")).otherwise(0.0)).drop("_d", "_v")


def kvo(df: DataFrame, fast: int, slow: int, signal: int) -> DataFrame:
    """SMA of (fast - slow SMA of volume signed by the typical price's direction), from the slow one's warm-up on."""
    df = typical(df).withColumn("_p", F.coalesce(BARS.lag("_tp"), F.lit(0.0)))
    df = df.withColumn("_sv", F.when(F.col("_tp") > F.col("_p"), F.col("volume")).when(F.col("_tp") < F.col("_p"), -F.col("volume")).otherwise(0.0))
    df = df.withColumn("_x", BARS.mean("_sv", fast) - BARS.mean("_sv", slow)).withColumn("_on", BARS.number() >= slow)
    inside = Series(["instrument", "_on"], "ts")
    value = F.when(F.col("_on"), F.avg("_x").over(inside.last(signal))).otherwise(0.0)
    return _ready(df.withColumn("kvo", value), slow + signal - 1).drop("_tp", "_p", "_sv", "_x", "_on")


def obv(df: DataFrame, n: int = 0) -> DataFrame:
    """Sum of volume signed by close against open, over the last n (0: all)."""
    signed = F.when(F.col("close") > F.col("open"), F.col("volume")).when(F.col("close") < F.col("open"), -F.col("volume")).otherwise(0.0)
    return _ready(df.withColumn("_s", signed).withColumn("obv", F.sum("_s").over(BARS.last(n) if n else BARS.all)), n or 1).drop("_s")


def pressure_sma(df: DataFrame, n: int, floor: float = 0.0) -> DataFrame:
    """((close - low) - (high - close)) / ATR * volume / mean volume, and its running sum; 0 where either is 0. SMAs."""
    df = atr(df, n, floor=floor).withColumn("_v", BARS.mean("volume", n))
    raw = ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / F.col("atr") * F.col("volume") / F.col("_v")
    df = df.withColumn("pressure", F.when((F.col("_v") == 0) | (F.col("atr") == 0), 0.0).otherwise(raw))
    return df.withColumn("cumulative", F.sum("pressure").over(BARS.all)).drop("_v", "atr")


def psychological_line(df: DataFrame, n: int, price: str = "close") -> DataFrame:
    up = F.when(F.col(price) > BARS.lag(price), 1.0).otherwise(0.0)
    return _ready(df.withColumn("_u", up).withColumn("psl", 100 * BARS.mean("_u", n)), n).drop("_u")


def swings(df: DataFrame, n: int) -> DataFrame:
    """Swing highs and lows of the last n: direction, changed, prices, bars since, length and duration."""
    w = BARS.last(n)
    hh, ll = F.max("high").over(w), F.min("low").over(w)
    high = (F.col("high") >= hh) & (F.col("low") >= ll)
    low = (F.col("low") <= ll) & (F.col("high") <= hh)
    df = df.withColumn("_i", BARS.number()).withColumn("_h", high & ~low).withColumn("_l", low & ~high)
    df = df.withColumn("_flag", F.when(F.col("_h"), 1).when(F.col("_l"), -1))
    df = df.withColumn("direction", F.coalesce(BARS.held("_flag"), F.lit(0)))
    before = F.last("_flag", ignorenulls=True).over(BARS.base.rowsBetween(-(1 << 30), -1))
    df = df.withColumn("changed", F.coalesce(F.col("_flag") == -before, F.lit(False)))
    df = df.withColumn("high_price", F.coalesce(BARS.held(F.when(F.col("_h"), F.col("high"))), F.lit(0.0))).withColumn("low_price", F.coalesce(BARS.held(F.when(F.col("_l"), F.col("low"))), F.lit(0.0)))
    df = df.withColumn("since_high", F.col("_i") - F.coalesce(BARS.held(F.when(F.col("_h"), F.col("_i"))), F.lit(0).cast("long")))
    df = df.withColumn("since_low", F.col("_i") - F.coalesce(BARS.held(F.when(F.col("_l"), F.col("_i"))), F.lit(0)))
    df = df.withColumn("ready", (F.col("high_price") != 0) & (F.col("low_price") != 0)).withColumn("_was", F.coalesce(BARS.lag("ready"), F.lit(False)))
    df = df.withColumn("length", F.when(F.col("_was"), F.col("high_price") - F.col("low_price")).otherwise(0.0))
    df = df.withColumn("duration", F.when(F.col("_was"), F.when(F.col("direction") == 1, F.col("since_low")).otherwise(F.col("since_high"))).otherwise(0))
    return df.drop("_i", "_h", "_l", "_flag", "_was")


def atr(df: DataFrame, n: int, use_previous: bool = True, floor: float = 0.0) -> DataFrame:
    """SMA of the true range (first previous close: its own), at least ``floor``."""
    prev = F.coalesce(BARS.lag("close"), "close")
    tr = F.greatest(prev, "high") - F.least("low", prev) if use_previous else F.col("high") - F.col("low")
    return _ready(df.withColumn("_tr", tr).withColumn("atr", F.greatest(BARS.mean("_tr", n), F.lit(floor))), n).drop("_tr")


def donchian(df: DataFrame, n: int) -> DataFrame:
    df = df.withColumn("upper", F.max("high").over(BARS.last(n))).withColumn("lower", F.min("low").over(BARS.last(n)))
    return _ready(df.withColumn("middle", (F.col("upper") + F.col("lower")) / 2), n)


def keltner(df: DataFrame, n: int, k: float) -> DataFrame:
    """SMA of the typical price and k ATRs each side; position of the close within."""
    df = typical(atr(df, n)).withColumn("middle", BARS.mean("_tp", n))
    df = df.withColumn("upper", F.col("middle") + k * F.col("atr")).withColumn("lower", F.col("middle") - k * F.col("atr"))
    half = (F.col("upper") - F.col("lower")) / 2
    return df.withColumn("position", F.when(half > 0, (F.col("close") - F.col("middle")) / half).otherwise(0.0)).drop("_tp", "atr")


def volatility_ratio(df: DataFrame, fast: int, slow: int) -> DataFrame:
    """Slow ATR over fast ATR; holds where the fast one is 0."""
    a = atr(df, fast).withColumnRenamed("atr", "_fast").drop("ready")
    a = atr(a, slow).withColumn("_v", F.when(F.col("_fast") > 0, F.col("atr") / F.col("_fast")))
    return a.withColumn("vr", F.coalesce(BARS.held("_v"), F.lit(0.0))).drop("_fast", "_v", "atr")


def rvi(df: DataFrame, n: int, scalar: float = 100.0, price: str = "close") -> DataFrame:
    """Relative volatility: sample deviation of the last n, by the close's direction, each averaged over n."""
    sd = F.coalesce(F.stddev_samp(price).over(BARS.last(n)), F.lit(0.0))
    prev = F.coalesce(BARS.lag(price), F.col(price))
    df = df.withColumn("_sd", sd).withColumn("_up", F.when(F.col(price) > prev, F.col("_sd")).otherwise(0.0)).withColumn("_dn", F.when(F.col(price) < prev, F.col("_sd")).otherwise(0.0))
    pos, neg = BARS.mean("_up", n), BARS.mean("_dn", n)
    return _ready(df.withColumn("rvi", F.when(pos + neg > 0, scalar * pos / (pos + neg)).otherwise(0.0)), n).drop("_sd", "_up", "_dn")


def fuzzy_candles(df: DataFrame, n: int, t1: float = 0.5, t2: float = 1.0, t3: float = 2.0, t4: float = 3.0) -> DataFrame:
    """Direction, size, body and wick classes of each candle against the means and deviations of the last n."""
    length = F.abs(F.col("high") - F.col("low"))
    share = lambda x: F.when(F.col("_len") == 0, 0.0).otherwise(x / F.col("_len"))
    df = df.withColumn("_len", length).withColumn("_body", share(F.abs(F.col("open") - F.col("close"))))
    df = df.withColumn("_upw", share(F.col("high") - F.greatest("open", "close"))).withColumn("_low", share(F.least("open", "close") - F.col("low")))
    w = BARS.last(n)

    def ladder(c: str, cuts: list[float]) -> Column:
        mean, sd = F.avg(c).over(w), F.stddev_pop(c).over(w)
        out = F.when(F.col(c) == 0, 0)
        for i, t in enumerate(cuts):
            out = out.when(F.col(c) <= mean + t * sd + 1e-12, i + 1)
        return out.otherwise(len(cuts) + 1)

    df = df.withColumn("direction", F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1).otherwise(0))
    df = df.withColumn("size", ladder("_len", [-t2, t1, t2, t3, t4])).withColumn("body", ladder("_body", [-t1, t1, t2])).withColumn("upper_wick", ladder("_upw", [-t1, t1, t2])).withColumn("lower_wick", ladder("_low", [-t1, t1, t2]))
    return _ready(df, n).drop("_len", "_body", "_upw", "_low")


def book_imbalance(tops: DataFrame) -> DataFrame:
    """Smaller over larger of the best sizes; 0 if either is missing."""
    both = (F.col("bid_size") > 0) & (F.col("ask_size") > 0)
    return tops.withColumn("imbalance", F.when(both, F.least("bid_size", "ask_size") / F.greatest("bid_size", "ask_size")).otherwise(0.0))
