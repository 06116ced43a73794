"""Window shapes that the operators share. Every window has a key and a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Series:
    """Rows of one key in a total order (time, then a tie-breaker)."""

    def __init__(self, key: str | list[str], *order: str):
        if not order:
            raise ValueError("a total order is needed")
        self.key, self.order = ([key] if isinstance(key, str) else key), order

    @property
    def base(self) -> WindowSpec:
        """Made when it is used: columns need a session."""
        return W.partitionBy(*self.key).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        """This row and the n - 1 before it."""
        return self.base.rowsBetween(-(n - 1), 0)

    def before(self, n: int) -> WindowSpec:
        """The n rows before this one."""
        return self.base.rowsBetween(-n, -1)

    @property
    def all(self) -> WindowSpec:
        """All rows up to this one."""
        return self.base.rowsBetween(W.unboundedPreceding, 0)

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(c, n).over(self.base)

    def number(self) -> Column:
        return F.row_number().over(self.base).cast("long")

    def mean(self, c, n: int) -> Column:
        return F.avg(c).over(self.last(n))

    def held(self, c) -> Column:
        """The last value that is not null, this row's included."""
        return F.last(c, ignorenulls=True).over(self.all)


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], order: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time, by one union and one window.

    No range join: both sides are dealt by the key once. ``order`` breaks ties among right rows.
    """
    names = left.columns
    order = order or []
    marked = left.select("*", F.lit(1 if inclusive else -1).alias("_side"), *[F.lit(None).cast(right.schema[o].dataType).alias(f"_o_{o}") for o in order], F.lit(None).alias("_r"))
    other = right.select(F.col(key), F.col(ts), F.lit(0).alias("_side"), *[F.col(o).alias(f"_o_{o}") for o in order], F.struct(*values).alias("_r"))
    both = marked.drop("_r").unionByName(other, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(ts, "_side", *[f"_o_{o}" for o in order]).rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side <> 0")
    return out.select(*names, *[F.col(f"_last.{v}").alias(v) for v in values])


def islands(df: DataFrame, key: str, value: str) -> DataFrame:
    """Runs of consecutive integers of each key: first, last and length."""
    run = F.col(value) - F.row_number().over(W.partitionBy(key).orderBy(value))
    return df.select(key, value).distinct().withColumn("run", run).groupBy(key, "run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("length")).drop("run")
