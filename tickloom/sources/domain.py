"""The market-data tables, as views over the driver's tables; all other modules read these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(ts) -> F.Column:
    """Nanoseconds since the epoch of a timestamp column (without zone: UTC)."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument (event type), account (user), price, size, aggressor (1 buyer, 0 seller), ts, seq."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_type").alias("instrument"), F.col("user_id").alias("account"), F.col("value").alias("price"), k.alias("size"),
        (F.col("event_id") % 2).alias("aggressor"), nanos(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, bid, ask, bid_size, ask_size, ts, seq."""
    t = trades(spark, sf_dir)
    return t.select("instrument", F.col("price").alias("bid"), (F.col("price") + 0.01 * (1 + F.col("size"))).alias("ask"), (F.col("size") + 1).alias("bid_size"), (100 - F.col("size")).alias("ask_size"), "ts", "seq")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, instrument, side (1 buy, -1 sell), qty, px, commission, ts, order_id, line; instruments are folded to 20 an account, so that positions turn over."""
    li = table(spark, sf_dir, "lineitem")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        F.col("l_suppkey").alias("account"), (F.col("l_partkey") % 20).alias("instrument"), F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(-1).alias("side"),
        F.col("l_quantity").alias("qty"), px.alias("px"), (F.col("l_tax") * F.col("l_extendedprice")).alias("commission"),
        nanos(F.col("l_shipdate")).alias("ts"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("seq_px"),
    )


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book deltas: instrument, action, side (BUY, SELL), price, size, order_id, last (end of a batch), ts, seq."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "click", "UPDATE").otherwise("ADD")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        (F.col("user_id") % 10).alias("instrument"), action.alias("action"), F.when(F.col("user_id") % 20 < 10, "BUY").otherwise("SELL").alias("side"),
        F.round(F.when(F.col("user_id") % 20 < 10, 100 - F.col("value") / 10).otherwise(100 + F.col("value") / 10), 0).alias("price"), (k + 1).alias("size"),
        F.col("user_id").alias("order_id"), (F.col("event_id") % 3 == 0).alias("last"), nanos(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"),
    )


#: The same views in SQL, as common table expressions.
TRADES_SQL = """trades AS (
  SELECT event_type AS instrument, user_id AS account, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size,
         event_id % 2 AS aggressor, epoch_us(ts) * 1000 AS ts, event_id AS seq FROM events)"""
QUOTES_SQL = TRADES_SQL + """, quotes AS (
  SELECT instrument, price AS bid, price + 0.01 * (1 + size) AS ask, size + 1 AS bid_size, 100 - size AS ask_size, ts, seq FROM trades)"""
FILLS_SQL = """fills AS (
  SELECT l_suppkey AS account, l_partkey % 20 AS instrument, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END AS side, l_quantity AS qty,
         l_extendedprice / l_quantity AS px, l_tax * l_extendedprice AS commission,
         epoch_us(l_shipdate) * 1000 AS ts, l_orderkey AS order_id, l_linenumber AS line, l_extendedprice AS seq_px FROM lineitem)"""
DELTAS_SQL = """deltas AS (
  SELECT user_id % 10 AS instrument, CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'click' THEN 'UPDATE' ELSE 'ADD' END AS action,
         CASE WHEN user_id % 20 < 10 THEN 'BUY' ELSE 'SELL' END AS side,
         round(CASE WHEN user_id % 20 < 10 THEN 100 - value / 10 ELSE 100 + value / 10 END, 0) AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS size, user_id AS order_id, event_id % 3 = 0 AS last, epoch_us(ts) * 1000 AS ts, event_id AS seq FROM events)"""
