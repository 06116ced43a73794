"""Streams of trades: windowed bars with a watermark, and any fold as a stateful operator.

Input columns: instrument, price, size, ts (ns), seq.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_event_time(trades: DataFrame) -> DataFrame:
    return trades.withColumn("event_time", F.timestamp_micros(F.expr("ts div 1000")))


def time_bars(trades: DataFrame, step: str, late: str = "0 seconds") -> DataFrame:
    """Bars [start, end) of a stream; a bar is emitted when the watermark passes its end, later trades are dropped."""
    at = F.struct("ts", "seq")
    rows = with_event_time(trades).withWatermark("event_time", late)
    out = rows.groupBy("instrument", F.window("event_time", step)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("n")
    )
    return out.select("instrument", (F.unix_micros("window.end") * 1000).alias("ts"), "open", "high", "low", "close", "volume", "n")


def sessions(trades: DataFrame, gap: str, late: str = "0 seconds") -> DataFrame:
    """Runs of an instrument's trades without a pause longer than the gap."""
    rows = with_event_time(trades).withWatermark("event_time", late)
    out = rows.groupBy("instrument", F.session_window("event_time", gap)).agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
    return out.select("instrument", (F.unix_micros("session_window.start") * 1000).alias("start"), (F.unix_micros("session_window.end") * 1000).alias("end"), "n", "volume")


def folded(rows: DataFrame, make: Callable[[], object], key: str, order: list[str], inputs: list[str], outputs: str) -> DataFrame:
    """A fold of tickloom.operators.folds over a stream: its pickled object is the key's state.

    Rows of a micro-batch are put in order; rows older than the last one seen of their key are
    dropped (the late rule of bar builders).
    """
    head = [key, *order]
    schema = T.StructType([rows.schema[c] for c in head] + list(T.StructType.fromDDL(outputs).fields))
    names = [f.name for f in schema.fields]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, last = pickle.loads(state.get[0]) if state.exists else (make(), None)
        own = pd.concat(list(parts)).sort_values(order)
        out = []
        for row in own[[*order, *inputs]].itertuples(index=False, name=None):
            at = row[: len(order)]
            if last is not None and at < last:
                continue
            last = at
            out += [(*k, *at, *o) for o in machine.step(row[len(order) :])]
        state.update((pickle.dumps((machine, last)),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, schema, "blob binary", "append", GroupStateTimeout.NoTimeout)


def to_catalog(bars: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Appends a stream to Parquet by instrument, exactly once; with no trigger it takes what there is and ends."""
    writer = bars.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).partitionBy("instrument")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
