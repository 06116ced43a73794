"""Readers of tick, bar, book, rate and database tables; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK_QUOTES = "timestamp string, bid_price double, ask_price double, bid_size double, ask_size double"
TICK_TRADES = "timestamp string, trade_id string, price double, size double, side string"
BARS = "timestamp string, open double, high double, low double, close double, volume double"
BOOK_UPDATES = "exchange string, symbol string, timestamp long, local_timestamp long, is_snapshot boolean, side string, price double, amount double"
TRADE_ROWS = "exchange string, symbol string, timestamp long, local_timestamp long, id string, side string, price double, amount double"
QUOTE_ROWS = "exchange string, symbol string, timestamp long, local_timestamp long, ask_amount double, ask_price double, bid_price double, bid_amount double"


def csv_ticks(spark: SparkSession, path: str, schema: str = TICK_QUOTES, fmt: str | None = None) -> DataFrame:
    """CSV (plain or gzipped) with a timestamp column, as ts (ns); rows whose time can't be read keep a null ts."""
    df = spark.read.csv(path, schema=schema, header=True)
    ts = F.try_to_timestamp("timestamp", F.lit(fmt)) if fmt else F.try_to_timestamp("timestamp")
    return df.withColumn("ts", F.unix_micros(ts) * 1000).drop("timestamp")


def csv_bars(spark: SparkSession, path: str) -> DataFrame:
    return csv_ticks(spark, path, BARS)


def parquet_ticks(spark: SparkSession, path: str, timestamp: str = "timestamp") -> DataFrame:
    return spark.read.parquet(path).withColumn("ts", F.unix_micros(F.col(timestamp).cast("timestamp")) * 1000).drop(timestamp)


def interest_rates(spark: SparkSession, path: str, row_tag: str = "Obs") -> DataFrame:
    """XML rate table: LOCATION, TIME (YYYY-MM or YYYY-Qn), Value."""
    return spark.read.format("xml").option("rowTag", row_tag).schema("LOCATION string, TIME string, Value double").load(path)


def vendor_deltas(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Book update rows as deltas; amount 0 deletes a level. ``limit`` is the caller's own wish."""
    df = spark.read.csv(path, schema=BOOK_UPDATES, header=True)
    df = df.limit(limit) if limit else df
    action = F.when(F.col("amount") == 0, "DELETE").when(F.col("is_snapshot"), "ADD").otherwise("UPDATE")
    return df.select(F.col("symbol").alias("instrument"), action.alias("action"), F.when(F.col("side") == "bid", "BUY").otherwise("SELL").alias("side"), "price", F.col("amount").alias("size"),
                     (F.col("timestamp") * 1000).alias("ts"), (F.col("local_timestamp") * 1000).alias("ts_init"), F.col("is_snapshot").cast("int").alias("flags"))


def vendor_snapshots(spark: SparkSession, path: str, levels: int = 5) -> DataFrame:
    """Wide snapshot rows ({asks,bids}[i].{price,amount}) as arrays of levels; missing levels go."""
    fields = ", ".join(f"`{s}[{i}].{c}` double" for i in range(levels) for s in ("asks", "bids") for c in ("price", "amount"))
    df = spark.read.csv(path, schema=f"exchange string, symbol string, timestamp long, local_timestamp long, {fields}", header=True)
    side = lambda s: F.filter(F.array(*[F.struct(F.col(f"`{s}[{i}].price`").alias("price"), F.col(f"`{s}[{i}].amount`").alias("size"), F.lit(1).alias("orders")) for i in range(levels)]), lambda x: x["price"].isNotNull())
    return df.select(F.col("symbol").alias("instrument"), (F.col("timestamp") * 1000).alias("ts"), (F.col("local_timestamp") * 1000).alias("ts_init"), side("bids").alias("bids"), side("asks").alias("asks"))


def vendor_trades(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, schema=TRADE_ROWS, header=True)
    side = F.when(F.col("side") == "buy", "BUYER").when(F.col("side") == "sell", "SELLER").otherwise("NO_AGGRESSOR")
    return df.select(F.col("symbol").alias("instrument"), "price", F.col("amount").alias("size"), side.alias("aggressor"), F.col("id").alias("trade_id"), (F.col("timestamp") * 1000).alias("ts"), (F.col("local_timestamp") * 1000).alias("ts_init"))


def vendor_quotes(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, schema=QUOTE_ROWS, header=True)
    return df.select(F.col("symbol").alias("instrument"), F.col("bid_price").alias("bid"), F.col("ask_price").alias("ask"), F.col("bid_amount").alias("bid_size"), F.col("ask_amount").alias("ask_size"), (F.col("timestamp") * 1000).alias("ts"), (F.col("local_timestamp") * 1000).alias("ts_init"))


def jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A database query; with a numeric column and its bounds, read in parts."""
    reader = spark.read.format("jdbc").option("url", url)
    if column and bounds:
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    else:
        reader = reader.option("query", query)
    return reader.load()
