"""The data catalog: Parquet by type and identifier, time-range queries, coverage intervals, maintenance.

Layout: root/type/identifier=<id>/part files; the identifier is a partition column, so its filter
prunes folders, and ranges of ts_init reach the Parquet scan. Writers refuse overlaps with what a
type and identifier already cover, unless told not to check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Overlap(ValueError):
    """What is written covers a time that is covered already."""


def time_range(df: DataFrame, start: int | None = None, end: int | None = None, where: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows from start to end, both included, that meet an extra condition."""
    if start is not None:
        df = df.where(F.col(ts) >= start)
    if end is not None:
        df = df.where(F.col(ts) <= end)
    return df.where(where) if where else df


def coverage(rows: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """First and last time of each key (a file's, or an identifier's)."""
    return rows.groupBy(*keys).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))


def missing(intervals: DataFrame, start: int, end: int, keys: list[str]) -> DataFrame:
    """Gaps of each key's closed integer intervals within [start, end]; overlapping ones merge."""
    clipped = intervals.where((F.col("end") >= start) & (F.col("start") <= end)).select(*keys, "start", "end")
    edge = intervals.select(*keys).distinct().withColumn("start", F.lit(end + 1)).withColumn("end", F.lit(end + 1))
    w = W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    all_ = clipped.unionByName(edge).withColumn("upto", F.coalesce(F.max("end").over(w), F.lit(start - 1)))
    gap = all_.select(*keys, (F.greatest("upto", F.lit(start - 1)) + 1).alias("start"), (F.col("start") - 1).alias("end"))
    return gap.where(F.col("start") <= F.col("end"))


class Catalog:
    """A folder of typed tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str) -> str:
        return f"{self.root}/{kind}"

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def kinds(self) -> list[str]:
        jvm, fs = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()) if fs.exists(root) else []

    def query(self, kind: str, identifiers: list[str] | None = None, start: int | None = None, end: int | None = None, where: str | None = None) -> DataFrame:
        """Rows of a type in (ts_init, seq) order; identifiers prune folders, the range reaches the scan."""
        df = self.spark.read.parquet(self._path(kind))
        if identifiers is not None:
            df = df.where(F.col("identifier").isin(identifiers))
        return time_range(df, start, end, where, "ts_init").orderBy("ts_init", *[c for c in ("seq",) if c in df.columns])

    def intervals(self, kind: str, identifier: str) -> list[tuple[int, int]]:
        """Coverage of each file, in order."""
        if kind not in self.kinds():
            return []
        df = self.spark.read.parquet(self._path(kind)).where(F.col("identifier") == identifier)
        got = coverage(df.withColumn("file", F.input_file_name()), ["file"], "ts_init").select("start", "end").orderBy("start", "end").collect()
        return [(r["start"], r["end"]) for r in got]

    def missing_intervals(self, kind: str, identifier: str, start: int, end: int) -> list[tuple[int, int]]:
        have = self.intervals(kind, identifier)
        if not have:
            return [(start, end)]
        df = self.spark.createDataFrame([("x", a, b) for a, b in have], "k string, start long, end long")
        return [(r["start"], r["end"]) for r in missing(df, start, end, ["k"]).orderBy("start").collect()]

    def last_timestamp(self, kind: str, identifier: str) -> int | None:
        return self.spark.read.parquet(self._path(kind)).where(F.col("identifier") == identifier).agg(F.max("ts_init")).first()[0]

    def write(self, kind: str, df: DataFrame, skip_disjoint_check: bool = False) -> None:
        """Appends rows (identifier, ts_init, ...), a sorted file an identifier; refuses overlaps."""
        if not skip_disjoint_check and kind in self.kinds():
            new = coverage(df, ["identifier"], "ts_init").withColumnsRenamed({"start": "a", "end": "b"})
            old = self.spark.read.parquet(self._path(kind)).withColumn("file", F.input_file_name())
            old = coverage(old, ["identifier", "file"], "ts_init")
            clash = old.join(new, "identifier").where("start <= b AND end >= a").limit(1).collect()
            if clash:
                raise Overlap(f"{kind} {clash[0]['identifier']}: {clash[0]['start']}..{clash[0]['end']} is covered")
        df.repartition("identifier").sortWithinPartitions("identifier", "ts_init").write.mode("append").partitionBy("identifier").option("compression", "snappy").parquet(self._path(kind))

    def _replace(self, kind: str, df: DataFrame) -> None:
        """Rewrites a type beside itself, then swaps folders."""
        jvm, fs = self._fs()
        new, old, now = (jvm.org.apache.hadoop.fs.Path(self._path(kind) + x) for x in ("__new", "__old", ""))
        df.write.mode("overwrite").partitionBy("identifier").parquet(new.toString())
        fs.rename(now, old)
        fs.rename(new, now)
        fs.delete(old, True)

    def consolidate(self, kind: str, period: int | None = None) -> None:
        """One sorted file an identifier, or one a period of so many ns."""
        df = self.spark.read.parquet(self._path(kind))
        if period is None:
            self._replace(kind, df.repartition("identifier").sortWithinPartitions("identifier", "ts_init"))
        else:
            by = F.expr(f"ts_init div {period}")
            files = df.select("identifier", by.alias("p")).distinct().count()
            self._replace(kind, df.withColumn("_p", by).repartitionByRange(max(1, files), "identifier", "_p").sortWithinPartitions("identifier", "ts_init").drop("_p"))

    def delete_range(self, kind: str, identifier: str | None = None, start: int | None = None, end: int | None = None) -> None:
        """Removes rows in [start, end] of an identifier (or all); files that lie partly inside are split."""
        df = self.spark.read.parquet(self._path(kind))
        inside = F.lit(True)
        if identifier is not None:
            inside &= F.col("identifier") == identifier
        if start is not None:
            inside &= F.col("ts_init") >= start
        if end is not None:
            inside &= F.col("ts_init") <= end
        self._replace(kind, df.where(~inside))
