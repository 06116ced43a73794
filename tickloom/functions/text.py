"""Topics and bar-type strings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of aggregation, by what closes a bar; fixed values.
TIME_KINDS = ("MILLISECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "YEAR")
THRESHOLD_KINDS = ("TICK", "VOLUME", "VALUE", "RENKO", "TICK_IMBALANCE", "VOLUME_IMBALANCE", "VALUE_IMBALANCE")
_BAR_TYPE = r"^(.+)-(\d+)-([A-Z_]+)-(BID|ASK|MID|LAST)-(INTERNAL|EXTERNAL)(?:@(\d+)-([A-Z_]+)-(INTERNAL|EXTERNAL))?$"


def topic_matches(topic: Column, pattern: str) -> Column:
    """``*`` stands for any run of characters, ``?`` for one."""
    return topic.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


@dataclass(frozen=True)
class BarType:
    """instrument-step-aggregation-price-source, with ``@step-aggregation-source`` for a composite one."""

    instrument: str
    step: int
    aggregation: str
    price: str
    source: str
    composite: tuple[int, str, str] | None = None

    @classmethod
    def parse(cls, text: str) -> BarType:
        m = re.match(_BAR_TYPE, text)
        if not m:
            raise ValueError(f"not a bar type: {text}")
        return cls(m[1], int(m[2]), m[3], m[4], m[5], (int(m[6]), m[7], m[8]) if m[6] else None)

    def __str__(self) -> str:
        end = "@{}-{}-{}".format(*self.composite) if self.composite else ""
        return f"{self.instrument}-{self.step}-{self.aggregation}-{self.price}-{self.source}{end}"

    @property
    def is_time(self) -> bool:
        return self.aggregation in TIME_KINDS

    @property
    def is_threshold(self) -> bool:
        return self.aggregation in THRESHOLD_KINDS


def bar_type_parts(text: Column) -> list[Column]:
    """instrument, step, aggregation, price, source of a column of bar types; empty strings where it is none."""
    names = ("instrument", "step", "aggregation", "price", "source")
    return [F.regexp_extract(text, _BAR_TYPE, i + 1).alias(n) for i, n in enumerate(names)]
