"""Queries of execution models, streams and sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions import calendar
from tickloom.operators import amm, bars, execution, folds
from tickloom.plans.common import Registry
from tickloom.sources import domain
from tickloom.sources.domain import table
from tickloom.streaming import bars as stream

R = Registry()
#: Added before rounding, so that averages that lie on a tie round alike in both engines.
TIE = 1e-8
Q, T = domain.QUOTES_SQL, domain.TRADES_SQL


def _orders(s, d):
    return domain.quotes(s, d).select("seq", "ts", F.when(F.col("seq") % 2 == 0, 1).otherwise(-1).alias("side"), F.col("bid_size").alias("qty"), "bid", "ask")


def _fill(model: str, **p):
    def query(s, d):
        o = _orders(s, d)
        args = {k: v() if callable(v) else v for k, v in p.items()}
        got, px = execution.fills(F.col("side"), F.col("qty"), F.col("bid"), F.col("ask"), 0.05, execution.tiers_of(model, F.col("qty"), **args))
        return o.select("seq", got.alias("filled"), (px + TIE).alias("avg_px"))

    return query


def _fill_sql(tiers: list[tuple[str, str | None]]) -> str:
    """Tiers as SQL: ticks and size (None: no end)."""
    left, takes = "qty", []
    for ticks, size in tiers:
        take = left if size is None else f"least({left}, {size})"
        takes.append((take, ticks))
        left = f"({left} - {take})"
    got = " + ".join(t for t, _ in takes)
    cost = " + ".join(f"{t} * (best + sign * {k} * 0.05)" for t, k in takes)
    return f"WITH {Q}, o AS (SELECT seq, bid_size AS qty, CASE WHEN seq % 2 = 0 THEN ask ELSE bid END AS best, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS sign FROM quotes) SELECT seq, round({got}, 6) AS filled, CASE WHEN {got} > 0 THEN round(({cost}) / ({got}) + 1e-8, 6) END AS avg_px FROM o"


R.add("fill_best_price", _fill("best_price"), _fill_sql([("0", None)]))
R.add("fill_one_tick_slippage", _fill("one_tick_slippage"), _fill_sql([("1", None)]))
R.add("fill_two_tier", _fill("two_tier"), _fill_sql([("0", "10"), ("1", None)]))
R.add("fill_three_tier", _fill("three_tier"), _fill_sql([("0", "50"), ("1", "30"), ("2", "20")]))
R.add("fill_partial_limit", _fill("partial_limit"), _fill_sql([("0", "5"), ("1", None)]))
R.add("fill_size_aware", _fill("size_aware"), _fill_sql([("0", "(CASE WHEN qty <= 10 THEN 50 ELSE 10 END)"), ("1", "(CASE WHEN qty <= 10 THEN 0 ELSE qty - 10 END)")]))
R.add("fill_market_hours", _fill("market_hours", low_liquidity=lambda: F.col("seq") % 5 == 0), _fill_sql([("(CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END)", None)]))
R.add("fill_volume_sensitive", _fill("volume_sensitive", recent_volume=lambda: F.lit(100.0)), _fill_sql([("0", "25"), ("1", None)]))
R.add("fill_competition", _fill("competition", visible=lambda: F.lit(100.0)), _fill_sql([("0", "30")]))
R.add("fill_probabilistic", _fill("probabilistic", order=lambda: F.col("seq")))
R.add("latency", lambda s, d: domain.trades(s, d).select("seq", execution.delayed(F.col("ts"), F.when(F.col("seq") % 2 == 0, "INSERT").otherwise("CANCEL"), 1_000_000, 2_000, 3_000, 4_000).alias("ts")), f"WITH {T} SELECT seq, ts + 1000000 + CASE WHEN seq % 2 = 0 THEN 2000 ELSE 4000 END AS ts FROM trades")
R.add("reconciliation_price", lambda s, d: table(s, d, "part").select("p_partkey", execution.reconciliation_price((F.col("p_partkey") % 7 - 3).cast("double"), F.lit(100.0), (F.col("p_partkey") % 5 - 2).cast("double"), F.col("p_retailprice") / 10).alias("px")),
      """WITH x AS (SELECT p_partkey, CAST(p_partkey % 7 - 3 AS DOUBLE) AS q, CAST(p_partkey % 5 - 2 AS DOUBLE) AS t, p_retailprice / 10 AS tp FROM part),
y AS (SELECT *, CASE WHEN q = 0 OR sign(q) * sign(t) < 0 THEN tp WHEN t = 0 THEN 100 ELSE (t * tp - q * 100) / (t - q) END AS px FROM x WHERE t <> q)
SELECT x.p_partkey, round(CASE WHEN px > 0 THEN px END, 6) AS px FROM x LEFT JOIN y ON x.p_partkey = y.p_partkey""")  # fmt: skip
_EVENT = "CASE instrument WHEN 'view' THEN 'SUBMITTED' WHEN 'click' THEN 'ACCEPTED' WHEN 'error' THEN 'REJECTED' WHEN 'purchase' THEN 'FILLED' ELSE 'CANCELED' END"
_ALLOWED = [(k.split(">")[0], k.split(">")[1]) for k in sorted(execution._table())]
R.add("order_invalid_transitions", lambda s, d: _events(s, d).transform(execution.invalid_transitions).select("order_id", "seq", "before", "event"),
      f"""WITH {T}, e AS (SELECT account AS order_id, ts, seq, {_EVENT} AS event FROM trades), x AS (SELECT *, coalesce(lag(event) OVER (PARTITION BY order_id ORDER BY ts, seq), 'INITIALIZED') AS before FROM e),
a(s, e) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _ALLOWED)}) SELECT order_id, seq, before, event FROM x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.s = x.before AND a.e = x.event)""")  # fmt: skip


def _events(s, d):
    """Trades as order events whose state is the event's own name."""
    name = F.create_map(*[F.lit(x) for kv in (("view", "SUBMITTED"), ("click", "ACCEPTED"), ("error", "REJECTED"), ("purchase", "FILLED"), ("signup", "CANCELED")) for x in kv])[F.col("instrument")]
    return domain.trades(s, d).select(F.col("account").alias("order_id"), "ts", "seq", name.alias("event"), name.alias("state"))


R.add("order_state_fold", lambda s, d: folds.fold(_events(s, d).withColumn("share", F.lit(1.0)), execution.OrderState, ["order_id"], ["ts", "seq"], ["event", "share"], "state string, allowed boolean"),
      f"""WITH RECURSIVE {T}, e AS (SELECT account AS order_id, ts, seq, {_EVENT} AS event, row_number() OVER (PARTITION BY account ORDER BY ts, seq) AS i FROM trades),
a(s, e, t) AS (VALUES {', '.join(f"('{k.split('>')[0]}', '{k.split('>')[1]}', '{to}')" for k, to in sorted(execution._table().items()))}),
f AS (SELECT order_id, CAST(NULL AS BIGINT) AS ts, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS i, 'INITIALIZED' AS state, true AS allowed FROM e WHERE i = 1 UNION ALL
SELECT e.order_id, e.ts, e.seq, e.i, coalesce(a.t, f.state), a.t IS NOT NULL FROM f JOIN e ON e.order_id = f.order_id AND e.i = f.i + 1 LEFT JOIN a ON a.s = f.state AND a.e = e.event)
SELECT order_id, ts, seq, state, allowed FROM f WHERE i > 0""")  # fmt: skip


def _session_sql(which: int, following: bool) -> str:
    """A session's opening (1) or close (2) in seconds of UTC: the zone's own weekday and hour, on or after (before) the trade's local time."""
    cols = []
    for name, session in calendar.SESSIONS.items():
        zone, hour = session[0], session[which]
        local = f"timezone('{zone}', make_timestamptz(ts // 1000))"
        at = f"date_trunc('day', {local}) + INTERVAL {hour} HOUR"
        if following:
            day = f"{at} + CASE WHEN {local} > {at} THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END"
            skip = f"CASE isodow({day}) WHEN 6 THEN INTERVAL 2 DAY WHEN 7 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END"
            day = f"{day} + {skip}"
        else:
            day = f"{at} - CASE WHEN {local} < {at} THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END"
            skip = f"CASE isodow({day}) WHEN 6 THEN INTERVAL 1 DAY WHEN 7 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END"
            day = f"{day} - {skip}"
        cols.append(f"CAST(epoch(timezone('{zone}', {day})) AS BIGINT) AS {name}")
    return f"WITH {T} SELECT seq, {', '.join(cols)} FROM trades"


R.add("session_next_start", lambda s, d: domain.trades(s, d).select("seq", F.timestamp_micros(F.expr("ts div 1000")).alias("t")).select("seq", *[F.unix_seconds(calendar.session_start(n, F.col("t"))).alias(n) for n in calendar.SESSIONS]), _session_sql(1, True))
R.add("session_previous_end", lambda s, d: domain.trades(s, d).select("seq", F.timestamp_micros(F.expr("ts div 1000")).alias("t")).select("seq", *[F.unix_seconds(calendar.session_end(n, F.col("t"), False)).alias(n) for n in calendar.SESSIONS]), _session_sql(2, False))


def _pool_events(s, d):
    """Each account's trades as one pool's events: a wide mint first, then mints and swaps."""
    t = domain.trades(s, d)
    first = t.groupBy("account").agg(F.min("seq").alias("f"))
    t = t.join(first, "account")
    mint = (F.col("seq") == F.col("f")) | (F.col("seq") % 5 == 0)
    width = F.when(F.col("seq") == F.col("f"), 60_000).otherwise(60 * (1 + F.col("seq") % 20))
    return t.select("account", "ts", "seq", F.when(mint, "mint").otherwise("swap").alias("kind"), (-width).alias("lower"), width.alias("upper"), F.when(mint, F.lit("1000000000000000000")).otherwise(F.lit("0")).alias("liquidity"),
                    F.format_string("%d000000000000", F.floor(F.col("price") * 100).cast("long")).alias("amount"), (F.col("seq") % 2 == 0).alias("zero_for_one"))


R.add("amm_pool_fold", lambda s, d: folds.fold(_pool_events(s, d), lambda: amm.Pool(amm.Q96), ["account"], ["ts", "seq"], ["kind", "lower", "upper", "liquidity", "amount", "zero_for_one"], amm.POOL_DDL))
R.add("bet_position_fold", lambda s, d: folds.fold(domain.trades(s, d).where("size > 0").select("account", "ts", "seq", F.when(F.col("aggressor") == 1, 1).otherwise(-1).alias("side"), (1 + F.col("price") / 50).alias("odds"), "size"), folds.BetPosition, ["account"], ["ts", "seq"], ["side", "odds", "size"], "price double, exposure double, pnl double"),
      f"""WITH RECURSIVE {T}, x AS (SELECT account, ts, seq, CASE WHEN aggressor = 1 THEN 1 ELSE -1 END AS side, 1 + price / 50 AS odds, size, row_number() OVER (PARTITION BY account ORDER BY ts, seq) AS i FROM trades WHERE size > 0),
f AS (SELECT account, CAST(NULL AS BIGINT) AS ts, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS i, 0::DOUBLE AS price, 0::DOUBLE AS exposure, 0::DOUBLE AS pnl FROM x WHERE i = 1 UNION ALL
SELECT x.account, x.ts, x.seq, x.i,
CASE WHEN f.exposure = 0 THEN x.odds WHEN same THEN f.price WHEN flips THEN x.odds WHEN flat THEN 0 ELSE f.price END,
CASE WHEN same THEN f.exposure + bet WHEN flips THEN x.side * (abs(bet) - closing) WHEN flat THEN 0 ELSE f.exposure + x.side * closing END,
CASE WHEN same THEN f.pnl ELSE f.pnl - x.side * (closing / x.odds - closing / f.price) END
FROM f JOIN x ON x.account = f.account AND x.i = f.i + 1, LATERAL (SELECT x.side * x.odds * x.size AS bet) b,
LATERAL (SELECT f.exposure = 0 OR (f.exposure > 0) = (bet > 0) AS same, least(abs(bet), abs(f.exposure)) AS closing) c, LATERAL (SELECT abs(bet) - closing > 1e-12 AS flips, abs(f.exposure + x.side * closing) < 1e-12 AS flat) k)
SELECT account, ts, seq, round(price, 6) AS price, round(exposure, 6) AS exposure, round(pnl, 6) AS pnl FROM f WHERE i > 0""")  # fmt: skip


def _streamed(s, d):
    """Hourly bars made by a stream over the events, read back: all bars whose end the watermark passed."""
    shared = s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir")
    at = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = table(s, d, "events").schema
    raw = s.readStream.schema(schema).parquet(d, pathGlobFilter="events.parquet")
    k = F.get_json_object("props", "$.k").cast("double")
    rows = raw.select(F.col("event_type").alias("instrument"), F.col("value").alias("price"), k.alias("size"), domain.nanos(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"))
    stream.to_catalog(stream.time_bars(rows, "1 hour"), f"{at}/out", f"{at}/state").awaitTermination()
    return s.read.parquet(f"{at}/out").select("instrument", "ts", "open", "high", "low", "close", "volume", "n")


H = bars.HOUR
R.add("stream_time_bars", _streamed,
      f"""WITH {T}, b AS (SELECT instrument, ts // {H} * {H} + {H} AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(size) AS volume, count(*) AS n FROM trades GROUP BY 1, 2)
SELECT instrument, ts, open, high, low, close, volume, n FROM b WHERE ts <= (SELECT max(ts) FROM trades)""")  # fmt: skip
