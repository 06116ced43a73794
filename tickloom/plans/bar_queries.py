"""Queries of the bar operators, with SQL twins."""

from __future__ import annotations

from tickloom.operators import bars
from tickloom.plans.common import HOURLY_SQL, Registry, bars_sql
from tickloom.sources.domain import TRADES_SQL, trades

R = Registry()
_COLUMNS = "instrument, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, CAST(n AS BIGINT) AS n"
for label, step in (("1m", bars.MINUTE), ("5m", 5 * bars.MINUTE), ("1h", bars.HOUR), ("4h", 4 * bars.HOUR), ("1d", bars.DAY), ("1s", bars.SECOND)):
    R.add(f"bars_time_{label}", lambda s, d, step=step: bars.time_bars(trades(s, d), step), f"WITH {TRADES_SQL}, {bars_sql(step)} SELECT {_COLUMNS} FROM bars")

H = bars.HOUR
_LEFT = f"""SELECT instrument, ts // {H} * {H} AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(size) AS volume, count(*) AS n FROM trades GROUP BY 1, 2"""
R.add("bars_time_left_open_stamp", lambda s, d: bars.time_bars(trades(s, d), H, closed="left", on_close=False), f"WITH {TRADES_SQL}, bars AS ({_LEFT}) SELECT {_COLUMNS} FROM bars")
R.add(
    "bars_time_origin_15m",
    lambda s, d: bars.time_bars(trades(s, d), H, origin=15 * bars.MINUTE),
    f"WITH {TRADES_SQL}, moved AS (SELECT * REPLACE (ts - {15 * bars.MINUTE} AS ts) FROM trades), {bars_sql(H, source='moved')} SELECT {_COLUMNS.replace('instrument, ts,', f'instrument, ts + {15 * bars.MINUTE} AS ts,')} FROM bars",
)
S7 = 7 * H
R.add(
    "bars_time_7h_daily_restart",
    lambda s, d: bars.time_bars(trades(s, d), S7),
    f"""WITH {TRADES_SQL}, placed AS (SELECT *, (ts - 1) // {bars.DAY} * {bars.DAY} AS day FROM trades),
bars AS (SELECT instrument, day + (ts - 1 - day) // {S7} * {S7} + {S7} AS ts, first(price ORDER BY placed.ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY placed.ts, seq) AS close, sum(size) AS volume, count(*) AS n
FROM placed GROUP BY 1, 2) SELECT {_COLUMNS} FROM bars""",
)
R.add("bars_time_skip_first", lambda s, d: bars.time_bars(trades(s, d), H, skip_first=True), f"WITH {HOURLY_SQL} SELECT {_COLUMNS} FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY ts) > 1)")
for unit, trunc in (("week", "date_trunc('week', make_timestamp(ts // 1000))"), ("month", "date_trunc('month', make_timestamp(ts // 1000))"), ("year", "date_trunc('year', make_timestamp(ts // 1000))")):
    R.add(
        f"bars_{unit}",
        lambda s, d, unit=unit: bars.calendar_bars(trades(s, d), unit),
        f"WITH {TRADES_SQL}, b AS (SELECT instrument, epoch_us(CAST({trunc} AS TIMESTAMP)) * 1000 AS start, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(size) AS volume, count(*) AS n FROM trades GROUP BY 1, 2) SELECT {_COLUMNS.replace(' ts,', ' start AS ts,', 1)} FROM b",
    )
R.add(
    "bars_fill_gaps",
    lambda s, d: bars.fill_gaps(bars.time_bars(trades(s, d), H), H),
    f"""WITH {HOURLY_SQL}, spine AS (SELECT instrument, unnest(range(min(ts), max(ts) + 1, {H})) AS ts FROM bars GROUP BY instrument),
j AS (SELECT s.instrument, s.ts, b.open, b.high, b.low, last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.instrument ORDER BY s.ts) AS close, coalesce(b.volume, 0) AS volume, coalesce(b.n, 0) AS n
FROM spine s LEFT JOIN bars b ON s.instrument = b.instrument AND s.ts = b.ts)
SELECT instrument, ts, round(coalesce(open, close), 6) AS open, round(coalesce(high, close), 6) AS high, round(coalesce(low, close), 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, CAST(n AS BIGINT) AS n FROM j""",
)
_OUT = "instrument, bar, round(first(price ORDER BY ts, seq), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(last(price ORDER BY ts, seq), 6) AS close"
R.add(
    "bars_tick_50",
    lambda s, d: bars.tick_bars(trades(s, d), 50),
    f"WITH {TRADES_SQL}, x AS (SELECT *, (row_number() OVER (PARTITION BY instrument ORDER BY ts, seq) - 1) // 50 AS bar FROM trades) SELECT {_OUT}, round(sum(size), 6) AS volume, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) = 50",
)
R.add(
    "bars_volume_500",
    lambda s, d: bars.volume_bars(trades(s, d), 500.0),
    f"""WITH {TRADES_SQL}, c AS (SELECT *, sum(size) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS hi FROM trades WHERE size > 0),
x AS (SELECT *, unnest(range(CAST(floor((hi - size) / 500) AS BIGINT), CAST(ceil(hi / 500) AS BIGINT))) AS bar FROM c),
y AS (SELECT *, least(hi, (bar + 1) * 500) - greatest(hi - size, bar * 500) AS part, max(hi) OVER (PARTITION BY instrument) AS total FROM x)
SELECT {_OUT}, round(sum(part), 6) AS volume, count(*) AS n FROM y WHERE part > 0 AND (bar + 1) * 500 <= total GROUP BY 1, 2""",
)
R.add(
    "bars_value_20000",
    lambda s, d: bars.value_bars(trades(s, d), 20_000),
    f"""WITH {TRADES_SQL}, v AS (SELECT *, CAST(round(price * size * 10000) AS BIGINT) AS amount FROM trades WHERE size > 0),
c AS (SELECT *, CAST(sum(amount) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM v WHERE amount > 0),
x AS (SELECT *, unnest(range((hi - amount) // 200000000, (hi + 199999999) // 200000000)) AS bar FROM c),
y AS (SELECT *, least(hi, (bar + 1) * 200000000) - greatest(hi - amount, bar * 200000000) AS part, max(hi) OVER (PARTITION BY instrument) AS total FROM x)
SELECT {_OUT}, round(sum(size * part / amount), 6) AS volume, count(*) AS n FROM y WHERE part > 0 AND (bar + 1) * 200000000 <= total GROUP BY 1, 2""",
)
R.add(
    "bars_composite_4h",
    lambda s, d: bars.composite_bars(bars.time_bars(trades(s, d), H), 4 * H),
    f"""WITH {HOURLY_SQL}, b AS (SELECT instrument, (ts + {4 * H} - 1) // {4 * H} * {4 * H} AS t, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, sum(n) AS n FROM bars GROUP BY 1, 2)
SELECT {_COLUMNS.replace(' ts,', ' t AS ts,', 1)} FROM b""",
)
R.add(
    "rows_monotone",
    lambda s, d: bars.monotone(trades(s, d)),
    f"WITH {TRADES_SQL}, x AS (SELECT instrument, ts < lag(ts) OVER (PARTITION BY instrument ORDER BY seq) AS back FROM trades) SELECT instrument, NOT coalesce(bool_or(back), false) AS monotone FROM x GROUP BY 1",
)
R.add(
    "rows_drop_late",
    lambda s, d: bars.drop_late(trades(s, d)).groupBy("instrument").count().withColumnRenamed("count", "kept"),
    f"WITH {TRADES_SQL}, x AS (SELECT instrument, ts, max(ts) OVER (PARTITION BY instrument ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM trades) SELECT instrument, count(*) AS kept FROM x WHERE b IS NULL OR ts >= b GROUP BY 1",
)
