"""Queries of catalog, wrangling, pricing, account and replay operators, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import calendar, pricing, text
from tickloom.operators import bars, replay, windows, wrangle
from tickloom.plans.common import HOURLY_SQL, Registry, bars_sql, hourly
from tickloom.plans.stat_queries import EPISODES_SQL, closed_positions
from tickloom.sources import catalog, domain
from tickloom.sources.domain import table

R = Registry()
T, Q, FL = domain.TRADES_SQL, domain.QUOTES_SQL, domain.FILLS_SQL
JAN10, JAN20 = 1704844800000000000, 1705708800000000000
HALF = 12 * bars.HOUR

# catalog ---------------------------------------------------------------------------------------
R.add("catalog_range", lambda s, d: catalog.time_range(domain.trades(s, d), JAN10, JAN20, "size > 50").select("instrument", "seq", "ts", "price"), f"WITH {T} SELECT instrument, seq, ts, round(price, 6) AS price FROM trades WHERE ts BETWEEN {JAN10} AND {JAN20} AND size > 50")
R.add("catalog_identifiers", lambda s, d: domain.trades(s, d).where(F.col("instrument").isin("view", "click")).groupBy("instrument").count().withColumnRenamed("count", "n"), f"WITH {T} SELECT instrument, count(*) AS n FROM trades WHERE instrument IN ('view', 'click') GROUP BY 1")
R.add("catalog_last_timestamp", lambda s, d: domain.trades(s, d).groupBy("instrument").agg(F.max("ts").alias("last")), f"WITH {T} SELECT instrument, max(ts) AS last FROM trades GROUP BY 1")


def _files(s, d):
    return domain.trades(s, d).withColumn("file", F.expr(f"ts div {HALF}"))


_FILES = f"files AS (SELECT instrument, ts // {HALF} AS file, min(ts) AS a, max(ts) AS b FROM trades GROUP BY 1, 2)"
R.add("catalog_intervals", lambda s, d: catalog.coverage(_files(s, d), ["instrument", "file"]), f"WITH {T}, {_FILES} SELECT instrument, file, a AS start, b AS \"end\" FROM files")
R.add("catalog_missing_intervals", lambda s, d: catalog.missing(catalog.coverage(_files(s, d), ["instrument", "file"]).drop("file"), JAN10, JAN20, ["instrument"]),
      f"""WITH {T}, {_FILES}, c AS (SELECT instrument, a, b FROM files WHERE b >= {JAN10} AND a <= {JAN20} UNION ALL SELECT DISTINCT instrument, {JAN20} + 1, {JAN20} + 1 FROM files),
g AS (SELECT instrument, greatest(coalesce(max(b) OVER (PARTITION BY instrument ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {JAN10} - 1), {JAN10} - 1) + 1 AS start, a - 1 AS "end" FROM c)
SELECT instrument, start, "end" FROM g WHERE start <= "end\"""")  # fmt: skip
R.add("catalog_merge_streams", lambda s, d: replay.merged({"trade": domain.trades(s, d).select("ts", "seq", "price"), "quote": domain.quotes(s, d).select("ts", "seq", "bid")}, {"quote": False}).withColumn("place", F.row_number().over(W.partitionBy(F.expr(f"ts div {bars.DAY}")).orderBy("ts", "priority", "seq")).cast("long")).select("type", "ts", "seq", "priority", "place"),
      f"WITH {Q}, m AS (SELECT 'trade' AS type, ts, seq, 1 AS priority FROM trades UNION ALL SELECT 'quote', ts, seq, -2 FROM quotes) SELECT type, ts, seq, priority, row_number() OVER (PARTITION BY ts // {bars.DAY} ORDER BY ts, priority, seq) AS place FROM m")
R.add("catalog_latest_client", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("client")), "SELECT o_custkey, last(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS client FROM orders GROUP BY 1")
R.add("catalog_continuous_runs", lambda s, d: windows.islands(domain.trades(s, d).where("price < 60"), "instrument", "seq"),
      f"WITH {T}, x AS (SELECT instrument, seq, seq - row_number() OVER (PARTITION BY instrument ORDER BY seq) AS run FROM trades WHERE price < 60) SELECT instrument, min(seq) AS first, max(seq) AS last, count(*) AS length FROM x GROUP BY instrument, run")
R.add("catalog_latest_3", lambda s, d: domain.trades(s, d).withColumn("index", F.row_number().over(W.partitionBy("instrument").orderBy(F.desc("ts"), F.desc("seq"))).cast("long") - 1).where(F.col("index") < 3).select("instrument", "index", "seq", "price"),
      f"WITH {T} SELECT instrument, row_number() OVER w - 1 AS index, seq, round(price, 6) AS price FROM trades WINDOW w AS (PARTITION BY instrument ORDER BY ts DESC, seq DESC) QUALIFY row_number() OVER w <= 3")

# wrangling -------------------------------------------------------------------------------------
R.add("wrangle_init_latency", lambda s, d: wrangle.with_init(domain.trades(s, d).withColumnRenamed("ts", "ts_event"), 5_000_000).select("seq", "ts_event", "ts_init"), f"WITH {T} SELECT seq, ts AS ts_event, ts + 5000000 AS ts_init FROM trades")
R.add("wrangle_quotes", lambda s, d: wrangle.quotes_from(domain.quotes(s, d).drop("bid_size"), 3), f"WITH {Q} SELECT instrument, ts, 1000000.0 AS bid_size, ask_size, round(bid, 6) AS bid, round(ask, 6) AS ask FROM quotes")
R.add("wrangle_bars_to_trades", lambda s, d: wrangle.bars_to_trades(hourly(s, d), digits=2),
      f"""WITH {HOURLY_SQL}, x AS (SELECT *, unnest([0, 1, 2, 3]) AS part FROM bars) SELECT instrument, ts + (part - 3) * 100000000 AS ts, part, round(CASE part WHEN 0 THEN open WHEN 1 THEN high WHEN 2 THEN low ELSE close END, 6) AS price,
greatest(volume / 4, 1) AS size, 'NO_AGGRESSOR' AS aggressor, CAST(ts + (part - 3) * 100000000 AS VARCHAR) AS trade_id FROM x""")  # fmt: skip


def _bid_ask_bars(s, d):
    q = domain.quotes(s, d)
    side = lambda c: bars.time_bars(q.select("instrument", F.col(c).alias("price"), F.col(f"{c}_size").alias("size"), "ts", "seq"), bars.HOUR)
    return side("bid"), side("ask")


R.add("wrangle_bars_to_quotes", lambda s, d: wrangle.bars_to_quotes(*_bid_ask_bars(s, d), digits=2),
      f"""WITH {Q}, b_ AS (SELECT instrument, bid AS price, bid_size AS size, ts, seq FROM quotes), a_ AS (SELECT instrument, ask AS price, ask_size AS size, ts, seq FROM quotes), {bars_sql(bars.HOUR, 'b', 'b_')}, {bars_sql(bars.HOUR, 'a', 'a_')},
x AS (SELECT instrument, ts, b.open AS bo, b.high AS bh, b.low AS bl, b.close AS bc, b.volume AS bv, a.open AS ao, a.high AS ah, a.low AS al, a.close AS ac, a.volume AS av, unnest([0, 1, 2, 3]) AS part FROM b JOIN a USING (instrument, ts))
SELECT instrument, ts + (part - 3) * 100000000 AS ts, part, round(CASE part WHEN 0 THEN bo WHEN 1 THEN bh WHEN 2 THEN bl ELSE bc END, 6) AS bid, round(CASE part WHEN 0 THEN ao WHEN 1 THEN ah WHEN 2 THEN al ELSE ac END, 6) AS ask,
greatest(bv / 4, 1) AS bid_size, greatest(av / 4, 1) AS ask_size FROM x""")  # fmt: skip


def _makers(s, d):
    return domain.trades(s, d).select("seq", (F.col("aggressor") == 0).alias("buyer_maker"))


R.add("wrangle_aggressor", lambda s, d: _makers(s, d).select("seq", wrangle.aggressor(_makers(s, d)).alias("aggressor")), f"WITH {T} SELECT seq, CASE WHEN aggressor = 0 THEN 'SELLER' ELSE 'BUYER' END AS aggressor FROM trades")
R.add("wrangle_snapshot_clear", lambda s, d: wrangle.snapshot_clear(domain.deltas(s, d).withColumn("flags", F.when(F.col("instrument") < 5, 32).otherwise(0))).groupBy("instrument", "action").count().withColumnRenamed("count", "n"),
      f"WITH {domain.DELTAS_SQL}, x AS (SELECT instrument, action FROM deltas UNION ALL SELECT DISTINCT instrument, 'CLEAR' FROM deltas WHERE instrument < 5) SELECT instrument, action, count(*) AS n FROM x GROUP BY 1, 2")

# pricing ---------------------------------------------------------------------------------------


def _options(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), (80 + F.col("p_size")).cast("double").alias("s"), F.lit(0.0425).alias("r"), F.lit(0.02).alias("b"), (0.1 + (F.col("p_partkey") % 40) / 100).alias("vol"), (F.col("p_partkey") % 2 == 0).alias("call"),
                    (70 + F.col("p_partkey") % 60).cast("double").alias("k"), ((1 + F.col("p_partkey") % 24) / 12).alias("t"))


OPTIONS_SQL = "o AS (SELECT p_partkey AS id, CAST(80 + p_size AS DOUBLE) AS s, CAST(0.0425 AS DOUBLE) AS r, CAST(0.02 AS DOUBLE) AS b, 0.1 + (p_partkey % 40) / 100.0::DOUBLE AS vol, p_partkey % 2 = 0 AS call, CAST(70 + p_partkey % 60 AS DOUBLE) AS k, (1 + p_partkey % 24) / 12.0::DOUBLE AS t FROM part)"
GREEKS_SQL = f"""{OPTIONS_SQL}, d AS (SELECT *, CASE WHEN call THEN 1 ELSE -1 END AS phi, vol * sqrt(t) AS sd, (ln(s / k) + (b + 0.5 * vol * vol) * t) / (vol * sqrt(t)) AS d1 FROM o),
e AS (SELECT *, phi * d1 AS x1, phi * (d1 - sd) AS x2, exp(-d1 * d1 / 2) / 2.5066282746310002 AS pdf, exp((b - r) * t) AS df, k * exp(-r * t) AS kt FROM d),
g AS (SELECT *, {pricing.norm_cdf_sql('x1')} AS c1, {pricing.norm_cdf_sql('x2')} AS c2, s * df AS st FROM e),
h AS (SELECT id, s, phi * (st * c1 - kt * c2) AS price, phi * df * c1 AS delta, df * pdf / (s * sd) AS gamma, st * sqrt(t) * pdf * 0.01 AS vega, (st * (-pdf * vol / (2 * sqrt(t)) - phi * (b - r) * c1) - phi * r * kt * c2) / 365.25 AS theta, vol, t FROM g)"""


def _greeks(s, d):
    o = _options(s, d)
    return o.select("id", "s", "vol", "t", "r", "b", "call", "k", *[c.alias(n) for n, c in pricing.black_scholes(*[F.col(x) for x in ("s", "r", "b", "vol", "call", "k", "t")]).items()])


_G = ("price", "delta", "gamma", "vega", "theta")
R.add("greeks_black_scholes", lambda s, d: _greeks(s, d).select("id", *_G), f"WITH {GREEKS_SQL} SELECT id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _G) + " FROM h")
R.add("greeks_implied_vol", lambda s, d: _greeks(s, d).where("vega > 0.02").select("id", pricing.implied_vol(F.col("price"), F.col("s"), F.col("r"), F.col("b"), F.col("call"), F.col("k"), F.col("t")).alias("vol")), f"WITH {GREEKS_SQL} SELECT id, round(vol, 4) AS vol FROM h WHERE vega > 0.02", 4)
R.add("greeks_portfolio", lambda s, d: _greeks(s, d).withColumn("qty", F.col("id") % 11 - 5).groupBy((F.col("id") % 4).alias("underlying")).agg(*[F.sum(F.col("qty") * F.col(c)).alias(c) for c in _G]), f"WITH {GREEKS_SQL} SELECT id % 4 AS underlying, " + ", ".join(f"round(sum((id % 11 - 5) * {c}), 5) AS {c}" for c in _G) + " FROM h GROUP BY 1", 5)
R.add("greeks_modified", lambda s, d: _greeks(s, d).select("id", *[c.alias(n) for n, c in pricing.modified_greeks(F.col("delta"), F.col("gamma"), F.col("s"), F.lit(1.2), F.lit(4000.0), True).items()]),
      f"WITH {GREEKS_SQL} SELECT id, round(delta * (1.2 * s / 4000) * 4000 / 100, 6) AS delta, round(gamma * pow(1.2 * s / 4000, 2) * pow(4000.0 / 100, 2), 6) AS gamma FROM h")
_lag = lambda x, y, t="t": " + ".join(f"{y[a]!r} * ({t} - {x[b]!r}) * ({t} - {x[c]!r}) / {(x[a] - x[b]) * (x[a] - x[c])!r}" for a, b, c in ((0, 1, 2), (1, 0, 2), (2, 0, 1)))
_TEN, _RAT = [0.25, 0.5, 1.0, 2.0], [0.05, 0.045, 0.042, 0.04]
_CURVE = f"""CASE WHEN t <= 0.25 THEN 0.05 WHEN t >= 2 THEN 0.04 WHEN t <= 0.5 THEN {_lag(_TEN[:3], _RAT[:3])} WHEN t <= 1 THEN (1 - t) / 0.5 * ({_lag(_TEN[:3], _RAT[:3])}) + (1 - (1 - t) / 0.5) * ({_lag(_TEN[1:], _RAT[1:])}) ELSE {_lag(_TEN[1:], _RAT[1:])} END"""
R.add("greeks_curve_rate", lambda s, d: _options(s, d).select("id", pricing.curve_rate(F.col("t"), _TEN, _RAT).alias("rate")), f"WITH {OPTIONS_SQL} SELECT id, round({_CURVE}, 6) AS rate FROM o")
R.add("synthetic_formula", lambda s, d: hourly(s, d).groupBy("ts").pivot("instrument", ["click", "view"]).agg(F.first("close")).dropna().select("ts", F.expr("(click + view) / 2 - least(click, view) * 0.1").alias("price")),
      f"WITH {HOURLY_SQL} SELECT ts, round((c.close + v.close) / 2 - least(c.close, v.close) * 0.1, 6) AS price FROM bars c JOIN bars v USING (ts) WHERE c.instrument = 'click' AND v.instrument = 'view'")
R.add("tick_scheme_fixed", lambda s, d: domain.trades(s, d).select("seq", pricing.tick_price(F.col("price"), 0.25, "bid", 1).alias("bid"), pricing.tick_price(F.col("price"), 0.25, "ask", 1).alias("ask")), f"WITH {T} SELECT seq, round((floor(round(price / 0.25, 9)) - 1) * 0.25, 6) AS bid, round((ceil(round(price / 0.25, 9)) + 1) * 0.25, 6) AS ask FROM trades")


def _legs(s, d):
    """At each spine hour, the latest quote of three legs, with ratios 1, -2, 1 and vegas."""
    q = domain.quotes(s, d)
    spine = s.range(JAN10, JAN20, 6 * bars.HOUR).withColumnRenamed("id", "ts")
    at = spine.withColumn("l", F.explode(F.array(*[F.struct(F.lit(n).alias("instrument"), F.lit(r).alias("ratio"), F.lit(v).alias("vega")) for n, r, v in (("click", 1.0, 0.2), ("view", -2.0, 0.3), ("error", 1.0, 0.25))]))).select("ts", "l.*")
    return spine, windows.asof(at, q, "instrument", "ts", ["bid", "ask", "bid_size", "ask_size"], ["seq"]).withColumn("tick", F.lit(0.05))


R.add("spread_quotes", lambda s, d: replay.spread_quotes(*_legs(s, d)),
      f"""WITH {Q}, l AS (SELECT * FROM (VALUES ('click', 1.0, 0.2), ('view', -2.0, 0.3), ('error', 1.0, 0.25)) AS v(instrument, ratio, vega), (SELECT unnest(range({JAN10}, {JAN20}, {6 * bars.HOUR})) AS ts)),
j AS (SELECT l.ts, CAST(ratio AS DOUBLE) AS ratio, CAST(vega AS DOUBLE) AS vega, bid, ask, bid_size, ask_size FROM l ASOF JOIN quotes q ON l.instrument = q.instrument AND l.ts >= q.ts),
g AS (SELECT ts, sum(ratio * (bid + ask) / 2) AS mid, abs(sum(ratio * vega)) * avg(abs((ask - bid) / vega)) AS w, min(bid_size) AS bid_size, min(ask_size) AS ask_size FROM j GROUP BY 1)
SELECT ts, round(floor(round((mid - w / 2) / 0.05, 9)) * 0.05, 6) AS bid, round(ceil(round((mid + w / 2) / 0.05, 9)) * 0.05, 6) AS ask, bid_size, ask_size FROM g""")  # fmt: skip

# accounts --------------------------------------------------------------------------------------


def _marked(s, d):
    """Open positions with the latest price of their instrument (its last fill's)."""
    p = closed_positions(s, d).where("qty <> 0")
    last = domain.fills(s, d).groupBy("instrument").agg(F.max_by("px", F.struct("ts", "order_id", "line", "qty", "px")).alias("last_px"))
    return p.join(last, "instrument")


_MARKED = EPISODES_SQL + ", l AS (SELECT instrument, last(px ORDER BY ts, order_id, line, qty, px) AS last_px FROM fills GROUP BY 1), mk AS (SELECT * FROM ep JOIN l USING (instrument) WHERE qty <> 0)"
R.add("account_net_exposure", lambda s, d: _marked(s, d).groupBy("account").agg(F.sum(F.col("qty") * F.col("last_px")).alias("net"), F.sum(F.abs(F.col("qty") * F.col("last_px"))).alias("gross"), F.sum("pnl").alias("realized")),
      f"WITH {_MARKED} SELECT account, round(sum(qty * last_px), 3) AS net, round(sum(abs(qty * last_px)), 3) AS gross, round(sum(pnl), 3) AS realized FROM mk GROUP BY 1", 3)
R.add("account_margins", lambda s, d: _marked(s, d).withColumn("n", pricing.notional(F.abs("qty"), F.col("last_px"), F.lit(1.0), F.lit(False))).groupBy("account").agg(F.sum(pricing.margin(F.col("n"), F.lit(0.05), F.lit(10.0))).alias("initial"), F.sum(pricing.margin(F.col("n"), F.lit(0.03), F.lit(10.0), leveraged=False)).alias("maintenance")),
      f"WITH {_MARKED} SELECT account, round(sum(abs(qty) * last_px / 10 * 0.05), 3) AS initial, round(sum(abs(qty) * last_px * 0.03), 3) AS maintenance FROM mk GROUP BY 1", 3)
R.add("account_side_flags", lambda s, d: _marked(s, d).groupBy("instrument").agg(F.sum("qty").alias("net")).select("instrument", "net", (F.col("net") > 0).alias("is_long"), (F.col("net") < 0).alias("is_short")), f"WITH {_MARKED} SELECT instrument, round(sum(qty), 6) AS net, sum(qty) > 0 AS is_long, sum(qty) < 0 AS is_short FROM mk GROUP BY 1")
R.add("account_free_balance", lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.sum("o_totalprice") * 0.001).alias("locked")), "c_custkey", "left").select("c_custkey", F.col("c_acctbal").alias("total"), F.coalesce("locked", F.lit(0.0)).alias("locked"), (F.col("c_acctbal") - F.coalesce("locked", F.lit(0.0))).alias("free")),
      "WITH l AS (SELECT o_custkey, sum(o_totalprice) * 0.001 AS locked FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT c_custkey, round(c_acctbal, 6) AS total, round(coalesce(locked, 0), 6) AS locked, round(c_acctbal - coalesce(locked, 0), 6) AS free FROM customer LEFT JOIN l ON o_custkey = c_custkey")
R.add("account_commissions", lambda s, d: domain.fills(s, d).withColumn("maker", F.col("line") % 2 == 0).groupBy("account").agg(F.sum(pricing.commission(F.col("qty") * F.col("px"), F.col("maker"), F.lit(0.0002), F.lit(0.0005))).alias("fees")), f"WITH {FL} SELECT account, round(sum(qty * px * CASE WHEN line % 2 = 0 THEN 0.0002 ELSE 0.0005 END), 4) AS fees FROM fills GROUP BY 1", 4)
R.add("risk_fixed_size", lambda s, d: _options(s, d).select("id", pricing.fixed_risk_size(F.col("s"), F.col("k"), F.lit(100_000.0), 0.01, 0.0002, 0.01).alias("size")).withColumn("size", F.floor("size")), f"WITH {OPTIONS_SQL} SELECT id, CAST(floor(CASE WHEN s = k THEN 0 ELSE floor((1000 - 1000 * 0.0002 * 2) / abs(s - k) / 0.01) * 0.01 END) AS BIGINT) AS size FROM o")
R.add("risk_checks", lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") <= 0, "PRICE").when(F.col("o_totalprice") > 400_000, "MAX_NOTIONAL").when(F.col("o_totalprice") < 5_000, "MIN_NOTIONAL").otherwise("OK").alias("reason")), "SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 'PRICE' WHEN o_totalprice > 400000 THEN 'MAX_NOTIONAL' WHEN o_totalprice < 5000 THEN 'MIN_NOTIONAL' ELSE 'OK' END AS reason FROM orders")
_FX = [("EUR", "USD", 1.08, 1.09), ("USD", "JPY", 150.0, 150.2), ("GBP", "USD", 1.26, 1.27), ("AUD", "JPY", 98.0, 98.1), ("NOK", "SEK", 1.0, 1.01)]
_FXV = ", ".join(f"('{a}', '{b}', CAST({(x + y) / 2!r} AS DOUBLE)), ('{b}', '{a}', CAST({2 / (x + y)!r} AS DOUBLE))" for a, b, x, y in _FX)
R.add("fx_rates", lambda s, d: replay.exchange_rates(s, _FX).select("source", "target", "rate", "hops", "path"),
      f"""WITH RECURSIVE e(f, t, r) AS (VALUES {_FXV}), p(source, target, rate, hops, path, seen) AS (SELECT f, t, r, 1, f || '>' || t, [f, t] FROM e UNION ALL SELECT p.source, e.t, p.rate * e.r, p.hops + 1, p.path || '>' || e.t, list_append(p.seen, e.t) FROM p JOIN e ON p.target = e.f WHERE NOT list_contains(p.seen, e.t) AND p.hops < 6)
SELECT source, target, round(rate, 6) AS rate, hops, path FROM p QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY hops, path) = 1""")  # fmt: skip
R.add("fx_rollover", lambda s, d: table(s, d, "nation").select("n_nationkey", pricing.overnight_rate(F.col("n_nationkey") / 4.0, F.lit(2.0)).alias("rate")), "SELECT n_nationkey, round((n_nationkey / 4.0 - 2) / 365 / 100, 6) AS rate FROM nation")
R.add("exec_spawn_totals", lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)).alias("filled")).withColumn("leaves", F.col("qty") - F.col("filled")), "SELECT l_orderkey, sum(l_quantity) AS qty, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS filled, sum(l_quantity) - sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS leaves FROM lineitem GROUP BY 1")
R.add("cache_order_counts", lambda s, d: table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
R.add("venue_rollup", lambda s, d: table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name", "n_name").agg(F.sum("s_acctbal").alias("balance"), F.count("*").alias("n")), "SELECT r_name, n_name, round(sum(s_acctbal), 3) AS balance, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)", 3)

# replay ----------------------------------------------------------------------------------------


def _as_orders(t):
    return t.select("instrument", F.col("seq").alias("order_id"), "ts", F.when(F.col("seq") % 2 == 0, 1).otherwise(-1).alias("side"), F.when(F.col("seq") % 3 == 0, "LIMIT").otherwise("STOP").alias("kind"), (F.col("price") + 30).alias("price"))


R.add("match_first_trigger", lambda s, d: replay.first_triggers(_as_orders(domain.trades(s, d)), domain.trades(s, d)),
      f"""WITH {T}, o AS (SELECT instrument, seq AS order_id, ts, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS side, CASE WHEN seq % 3 = 0 THEN 'LIMIT' ELSE 'STOP' END AS kind, price + 30 AS price FROM trades)
SELECT o.instrument, order_id, min(t.ts) AS trigger_ts, round(arg_min(t.price, (t.ts, t.seq)), 6) AS trigger_px FROM o JOIN trades t ON t.instrument = o.instrument AND t.ts > o.ts AND CASE WHEN (kind = 'LIMIT') = (side = 1) THEN t.price <= o.price ELSE t.price >= o.price END GROUP BY 1, 2""")  # fmt: skip
R.add("throttle_3_per_day", lambda s, d: replay.throttled(domain.trades(s, d).select("account", "ts", "seq"), 3, bars.DAY, "account", ["ts", "seq"]).select("seq", "sent", "allowed"),
      f"""WITH RECURSIVE {T}, x AS (SELECT account, ts, seq, row_number() OVER (PARTITION BY account ORDER BY ts, seq) AS i FROM trades),
f AS (SELECT account, seq, i, [ts] AS sent, true AS allowed FROM x WHERE i = 1 UNION ALL
SELECT x.account, x.seq, x.i, CASE WHEN len(k.live) < 3 THEN list_append(k.live, x.ts) ELSE k.live END, len(k.live) < 3 FROM f JOIN x ON x.account = f.account AND x.i = f.i + 1, LATERAL (SELECT list_filter(f.sent, lambda t: x.ts - t < {bars.DAY}) AS live) k)
SELECT seq, len(sent) AS sent, allowed FROM f""")  # fmt: skip
R.add("fees_per_contract", lambda s, d: domain.fills(s, d).groupBy("account").agg(F.sum(wrangle.fee("per_contract", amount=1.25)).alias("fee")), f"WITH {FL} SELECT account, sum(qty * 1.25) AS fee FROM fills GROUP BY 1")
R.add("fees_fixed_once", lambda s, d: domain.fills(s, d).groupBy("account").agg((F.countDistinct("order_id") * 2.5).alias("fee")), f"WITH {FL} SELECT account, count(DISTINCT order_id) * 2.5 AS fee FROM fills GROUP BY 1")


def _bets(s, d):
    t = domain.trades(s, d).where("size > 0")
    return t.select("seq", "instrument", F.when(F.col("aggressor") == 1, 1).otherwise(-1).alias("side"), (1 + F.col("price") / 50).alias("odds"), F.col("size").alias("stake"))


_BETS = f"{T}, b AS (SELECT seq, instrument, CASE WHEN aggressor = 1 THEN 1 ELSE -1 END AS side, 1 + price / 50 AS odds, size AS stake FROM trades WHERE size > 0)"
R.add("bet_terms", lambda s, d: _bets(s, d).select("seq", *[c.alias(n) for n, c in pricing.bet(F.col("side"), F.col("odds"), F.col("stake")).items()], pricing.hedging_stake(F.col("odds"), F.col("stake"), F.lit(2.0)).alias("hedge")),
      f"""WITH {_BETS} SELECT seq, round(side * odds * stake, 6) AS exposure, round(CASE side WHEN 1 THEN stake ELSE stake * (odds - 1) END, 6) AS liability, round(CASE side WHEN 1 THEN stake * (odds - 1) ELSE stake END, 6) AS profit,
round(side * stake * (odds - 1), 6) AS win_payoff, -side * stake AS lose_payoff, round(stake * odds / 2, 6) AS hedge FROM b""")  # fmt: skip
R.add("bet_pnl", lambda s, d: _bets(s, d).groupBy("instrument").agg(F.sum(pricing.bet(F.col("side"), F.col("odds"), F.col("stake"))["win_payoff"]).alias("pnl")), f"WITH {_BETS} SELECT instrument, round(sum(side * stake * (odds - 1)), 4) AS pnl FROM b GROUP BY 1", 4)
R.add("topic_match", lambda s, d: table(s, d, "nation").select(F.concat(F.lit("data.quotes."), "n_name").alias("topic")).where(text.topic_matches(F.col("topic"), "data.*.NATION_1?")), "SELECT 'data.quotes.' || n_name AS topic FROM nation WHERE regexp_matches('data.quotes.' || n_name, '^data\\..*\\.NATION_1.$')")
R.add("bar_type_parts", lambda s, d: table(s, d, "region").select(F.concat("r_name", F.lit(".SIM-5-MINUTE-BID-EXTERNAL")).alias("t")).select(*text.bar_type_parts(F.col("t"))), "SELECT r_name || '.SIM' AS instrument, '5' AS step, 'MINUTE' AS aggregation, 'BID' AS price, 'EXTERNAL' AS source FROM region")
R.add("calendar_last_weekday", lambda s, d: table(s, d, "orders").select("o_orderkey", calendar.last_weekday(F.to_date("o_orderdate")).cast("string").alias("day")), "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - CAST(CASE dayofweek(o_orderdate) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS VARCHAR) AS day FROM orders")
R.add("stat_kernels", lambda s, d: domain.trades(s, d).groupBy("instrument").agg(F.avg("price").alias("mean"), F.stddev_pop("price").alias("std"), F.sqrt(F.avg((F.col("price") - 40) * (F.col("price") - 40))).alias("std_about_40")), f"WITH {T} SELECT instrument, round(avg(price), 6) AS mean, round(stddev_pop(price), 6) AS std, round(sqrt(avg((price - 40) * (price - 40))), 6) AS std_about_40 FROM trades GROUP BY 1")
R.add("news_next_event", lambda s, d: windows.asof(domain.trades(s, d).select("instrument", (-F.col("ts")).alias("back"), "seq"), domain.trades(s, d).where("size > 95").select("instrument", (-F.col("ts")).alias("back"), F.col("seq").alias("next_seq"), F.col("ts").alias("next_ts")), "instrument", "back", ["next_seq", "next_ts"], ["next_seq"]).select("instrument", "seq", "next_seq", "next_ts"),
      f"WITH {T}, n AS (SELECT instrument, ts, seq FROM trades WHERE size > 95) SELECT t.instrument, t.seq, n.seq AS next_seq, n.ts AS next_ts FROM trades t ASOF LEFT JOIN n ON t.instrument = n.instrument AND t.ts <= n.ts")
R.add("order_status_last", lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linestatus", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")).alias("status")), "SELECT l_orderkey, last(l_linestatus ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS status FROM lineitem GROUP BY 1")
R.add("option_expiry", lambda s, d: _options(s, d).select("id", F.when(F.col("call"), F.col("s") > F.col("k")).otherwise(F.col("s") < F.col("k")).alias("itm"), F.greatest(F.when(F.col("call"), F.col("s") - F.col("k")).otherwise(F.col("k") - F.col("s")), F.lit(0.0)).alias("payoff")), f"WITH {OPTIONS_SQL} SELECT id, CASE WHEN call THEN s > k ELSE s < k END AS itm, greatest(CASE WHEN call THEN s - k ELSE k - s END, 0) AS payoff FROM o")
