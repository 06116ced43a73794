"""Queries of the order-book operators, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import book, windows
from tickloom.plans.common import Registry
from tickloom.sources import domain

R = Registry()
ORDERS_SQL = (
    domain.DELTAS_SQL
    + """, o AS (SELECT instrument, order_id, max(seq) FILTER (action = 'ADD') AS added, max(seq) FILTER (action = 'DELETE') AS gone,
  max(seq) FILTER (action <> 'DELETE') AS placed FROM deltas GROUP BY 1, 2),
orders_ AS (SELECT d.instrument, d.order_id, d.side, d.price, d.size, d.ts, d.seq FROM o JOIN deltas d ON d.seq = o.placed WHERE o.added IS NOT NULL AND (o.gone IS NULL OR o.added > o.gone)),
levels AS (SELECT instrument, side, price, sum(size) AS size, count(*) AS orders FROM orders_ GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY instrument, side ORDER BY CASE side WHEN 'BUY' THEN -price ELSE price END) AS level,
  sum(size) OVER (PARTITION BY instrument, side ORDER BY CASE side WHEN 'BUY' THEN -price ELSE price END ROWS UNBOUNDED PRECEDING) AS upto,
  sum(size * price) OVER (PARTITION BY instrument, side ORDER BY CASE side WHEN 'BUY' THEN -price ELSE price END ROWS UNBOUNDED PRECEDING) AS value_upto FROM levels)"""
)


def orders(s, d):
    return book.open_orders(domain.deltas(s, d))


def lv(s, d):
    return book.levels(orders(s, d))


def _sql(body: str) -> str:
    return f"WITH {ORDERS_SQL} {body}"


_TOP = """t AS (SELECT instrument, max(price) FILTER (side = 'BUY') AS bid_price, arg_max(size, price) FILTER (side = 'BUY') AS bid_size, min(price) FILTER (side = 'SELL') AS ask_price, arg_min(size, price) FILTER (side = 'SELL') AS ask_size FROM levels GROUP BY 1)"""
R.add("book_open_orders", lambda s, d: orders(s, d).select("instrument", "order_id", "side", "price", "size", "seq"), _sql("SELECT instrument, order_id, side, price, size, seq FROM orders_"))
R.add("book_levels", lv, _sql("SELECT instrument, side, price, size, orders FROM levels"))
R.add("book_top", lambda s, d: book.top(lv(s, d)), _sql(", ".join(["SELECT instrument, bid_price, bid_size, ask_price, ask_size, round(ask_price - bid_price, 6) AS spread, round((ask_price + bid_price) / 2, 6) AS midpoint FROM t"])).replace(" SELECT instrument, bid_price", f", {_TOP} SELECT instrument, bid_price"))
R.add("book_depth_5", lambda s, d: book.depth(lv(s, d), 5), _sql("SELECT instrument, side, price, size, orders, level FROM ranked WHERE level <= 5"))
R.add("book_grouped_5_top3", lambda s, d: book.grouped(lv(s, d), 5.0, 3),
      _sql(""", g AS (SELECT instrument, side, CASE side WHEN 'BUY' THEN floor(price / 5) ELSE ceil(price / 5) END * 5 AS price, sum(size) AS size FROM levels GROUP BY 1, 2, 3)
SELECT instrument, side, price, size FROM g QUALIFY row_number() OVER (PARTITION BY instrument, side ORDER BY CASE side WHEN 'BUY' THEN -price ELSE price END) <= 3""").replace(") , g", "), g"))  # fmt: skip
R.add("book_without_own", lambda s, d: book.without_own(lv(s, d), orders(s, d).where("side = 'BUY'")),
      _sql(", own AS (SELECT instrument, side, price, sum(size) AS own FROM orders_ WHERE side = 'BUY' GROUP BY 1, 2, 3) SELECT instrument, side, price, greatest(size - coalesce(own, 0), 0) AS size, orders FROM levels LEFT JOIN own USING (instrument, side, price) WHERE size - coalesce(own, 0) > 0"))
R.add("book_quantity_for_price", lambda s, d: book.quantity_for_price(lv(s, d), 100.0), _sql("SELECT instrument, coalesce(sum(size) FILTER (side = 'SELL' AND price <= 100), 0) AS buy_qty, coalesce(sum(size) FILTER (side = 'BUY' AND price >= 100), 0) AS sell_qty FROM levels GROUP BY 1"))
R.add("book_sweep_120", lambda s, d: book.sweep(lv(s, d), 120.0), _sql(", k AS (SELECT *, least(size, greatest(120 - (upto - size), 0)) AS take FROM ranked) SELECT instrument, side, round(sum(price * take) / sum(take), 6) AS avg_px, sum(take) AS qty FROM k WHERE take > 0 GROUP BY 1, 2"))
R.add("book_sweep_exposure", lambda s, d: book.sweep_exposure(lv(s, d), 10_000.0),
      _sql(", k AS (SELECT *, least(size * price, greatest(10000 - (value_upto - size * price), 0)) AS take FROM ranked) SELECT instrument, side, round(sum(take) / sum(take / price), 6) AS avg_px, round(sum(take / price), 6) AS qty, arg_max(price, level) AS last_px FROM k WHERE take > 0 AND price > 0 GROUP BY 1, 2"))
R.add("book_simulate_fills", lambda s, d: book.simulate_fills(orders(s, d), "BUY", 200.0, 110.0),
      _sql(", k AS (SELECT *, sum(size) OVER (PARTITION BY instrument ORDER BY price, ts, seq ROWS UNBOUNDED PRECEDING) - size AS b FROM orders_ WHERE side = 'SELL' AND price <= 110) SELECT instrument, order_id, price, least(size, 200 - b) AS fill FROM k WHERE b < 200"))
R.add("book_uncrossed", lambda s, d: book.uncrossed(lv(s, d)), _sql(f", {_TOP} SELECT instrument, side, price, size, orders FROM levels JOIN t USING (instrument) WHERE NOT coalesce(bid_price >= ask_price, false) OR CASE side WHEN 'BUY' THEN price < ask_price ELSE price > bid_price END"))
R.add("book_integrity", lambda s, d: book.integrity(lv(s, d)), _sql(f", {_TOP}, n AS (SELECT instrument, CAST(count(*) FILTER (side = 'BUY') AS BIGINT) AS bids, CAST(count(*) FILTER (side = 'SELL') AS BIGINT) AS asks FROM levels GROUP BY 1) SELECT instrument, bids, asks, coalesce(bid_price < ask_price, true) AS uncrossed FROM n JOIN t USING (instrument)"))
R.add("book_exposure", lambda s, d: book.exposure(lv(s, d)), _sql("SELECT instrument, side, sum(size) AS size, round(sum(size * price), 6) AS exposure FROM levels GROUP BY 1, 2"))
R.add("book_batches", lambda s, d: book.batches(domain.deltas(s, d)).groupBy("instrument", "batch").count().withColumnRenamed("count", "n"),
      f"WITH {domain.DELTAS_SQL}, b AS (SELECT instrument, coalesce(sum(CAST(last AS BIGINT)) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS batch FROM deltas) SELECT instrument, CAST(batch AS BIGINT) AS batch, count(*) AS n FROM b GROUP BY 1, 2")
R.add("book_audit_open", lambda s, d: book.audit_open(domain.deltas(s, d).select("order_id", "instrument").distinct(), orders(s, d).select("order_id")), _sql("SELECT DISTINCT order_id, instrument FROM deltas WHERE order_id IN (SELECT order_id FROM orders_)"))
R.add("book_depth_round_trip", lambda s, d: book.from_depth(book.depth_arrays(lv(s, d), 10).withColumn("ts", F.lit(0)).withColumn("seq", F.lit(0))), _sql("SELECT instrument, side, price, size, orders FROM ranked WHERE level <= 10"))
SNAP = 6 * 3600 * 10**9


def snapshots(s, d):
    """Six-hourly samples of the latest quote: a spine as-of joined to the quotes."""
    q = domain.quotes(s, d)
    ends = q.groupBy("instrument").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    spine = ends.select("instrument", F.explode(F.sequence(F.expr(f"a div {SNAP} * {SNAP} + {SNAP}"), F.expr(f"b div {SNAP} * {SNAP}"), F.lit(SNAP))).alias("ts"))
    return windows.asof(spine, q, "instrument", "ts", ["bid", "ask"], ["seq"])


R.add("book_snapshots_6h", snapshots,
      f"""WITH {domain.QUOTES_SQL}, spine AS (SELECT instrument, unnest(range(min(ts) // {SNAP} * {SNAP} + {SNAP}, max(ts) // {SNAP} * {SNAP} + 1, {SNAP})) AS ts FROM quotes GROUP BY instrument)
SELECT s.instrument, s.ts, round(q.bid, 6) AS bid, round(q.ask, 6) AS ask FROM spine s ASOF LEFT JOIN quotes q ON s.instrument = q.instrument AND s.ts >= q.ts""")  # fmt: skip
