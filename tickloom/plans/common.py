"""How queries are registered, and what their SQL twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import bars
from tickloom.sources import domain

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None, digits: int = 6) -> None:
        """Doubles are rounded, as engines add in different orders."""
        if name in self.queries:
            raise ValueError(f"{name} is taken")
        self.queries[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
        if sql is not None:
            self.oracle[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at so many digits, without negative zeros; decimals as doubles."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of every instrument: the input of the indicator queries."""
    return bars.time_bars(domain.trades(spark, sf_dir), bars.HOUR)


def bars_sql(step: int, name: str = "bars", source: str = "trades") -> str:
    return f"""{name} AS (
  SELECT instrument, (ts + {step} - 1) // {step} * {step} AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, seq) AS close, sum(size) AS volume, count(*) AS n FROM {source} GROUP BY 1, 2)"""


HOURLY_SQL = domain.TRADES_SQL + ", " + bars_sql(bars.HOUR)
