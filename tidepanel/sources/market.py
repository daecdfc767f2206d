"""Where prices come from: named sources, a cache of panels, and ingestion into a store."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.returns import simple_returns
from .bars import prices
from .frames import aligned
from .store import PriceStore, Report
from .synthetic import synthetic_prices

MOST_TICKERS, SHOWN_REVISIONS = 100, 100
PATTERN = r"^[A-Za-z0-9.\-]{1,12}$"


class SourceError(LookupError):
    """A source lacks what was asked for."""


def wanted(tickers: Sequence[str], start: date | None = None, end: date | None = None) -> list[str]:
    """Tickers in upper case, each once, in the order they came; raises ValueError for a request that can't be meant."""
    import re

    out = list(dict.fromkeys(t.upper() for t in tickers))
    if not out or len(out) > MOST_TICKERS:
        raise ValueError(f"between 1 and {MOST_TICKERS} tickers can be asked for")
    if bad := [t for t in out if not re.match(PATTERN, t)]:
        raise ValueError(f"not a ticker: {bad[0]}")
    if start is not None and end is not None and start >= end:
        raise ValueError("the start lies before the end")
    return out


@dataclass
class Market:
    """Prices by a named source: ``synthetic``, ``parquet`` (a store, and never anything else in its place), or a
    function given under another name. Panels are kept for ``ttl`` seconds."""

    spark: SparkSession
    source: str = "synthetic"
    store: PriceStore | None = None
    providers: dict[str, Callable[[SparkSession, list[str], date, date], DataFrame]] = field(default_factory=dict)
    ttl: float = 900.0
    _kept: dict = field(default_factory=dict)

    def _fetch(self, tickers: list[str], start: date, end: date) -> DataFrame:
        if self.source == "synthetic":
            return synthetic_prices(self.spark, tickers, start, end)
        if self.source == "parquet":
            if self.store is None:
                raise SourceError("there is no store")
            asked = self.spark.createDataFrame([(t,) for t in tickers], "ticker string")
            if missing := [r.ticker for r in asked.join(self.store.tickers(), "ticker", "left_anti").orderBy("ticker").collect()]:
                raise SourceError(f"not in the store: {', '.join(missing)}")
            return prices(self.store.scan(tickers, start, end))
        if self.source in self.providers:
            return self.providers[self.source](self.spark, tickers, start, end)
        raise SourceError(f"unknown source: {self.source}")

    def prices(self, tickers: Sequence[str], start: date, end: date) -> DataFrame:
        """The long panel on the calendar that all its tickers share."""
        names = wanted(tickers, start, end)
        key, now = (self.source, tuple(sorted(names)), start, end), time.monotonic()
        for old, (since, frame) in list(self._kept.items()):
            if now - since > self.ttl:
                frame.unpersist()
                del self._kept[old]
        if key not in self._kept:
            self._kept[key] = (now, aligned(self._fetch(names, start, end)).persist())
        return self._kept[key][1]

    def returns(self, tickers: Sequence[str], start: date, end: date) -> DataFrame:
        return simple_returns(self.prices(tickers, start, end))

    def clear(self) -> None:
        for _, frame in self._kept.values():
            frame.unpersist()
        self._kept.clear()

    def ingest(self, bars: DataFrame, at: datetime | None = None) -> tuple[Report, DataFrame]:
        """Upserts bars into the store: the report and its first revisions. What was kept is forgotten."""
        if self.store is None:
            raise SourceError("there is no store")
        if bars.isEmpty():
            raise SourceError("nothing came from the source")
        report = self.store.write(bars, at)
        self.clear()
        return report, report.revisions.orderBy("ticker", "date").limit(SHOWN_REVISIONS)


def from_provider(wide: DataFrame, fields: Sequence[str], index: str = "date") -> DataFrame:
    """Bars from a provider's wide table with columns like ``close|AAA``: a row for each date and ticker; an adjusted
    close that is missing is the close."""
    tickers = sorted({c.split("|", 1)[1] for c in wide.columns if "|" in c})
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("ticker"), *(F.col(f"`{f}|{t}`").alias(f) if f"{f}|{t}" in wide.columns else F.lit(None).cast("double").alias(f) for f in fields)) for t in tickers)))
    long = wide.select(F.col(index).cast("date").alias("date"), rows.alias("bar")).select("date", "bar.*").withColumn("ticker", F.upper("ticker"))
    if "close" in fields:
        adjusted = F.coalesce("adj_close", "close") if "adj_close" in fields else F.col("close")
        long = long.withColumn("adj_close", adjusted)
    return long.dropna(subset=["adj_close"])
