"""A price provider as a Spark data source: ``spark.read.format("prices").options(...).load()``.

A provider is a function of tickers, a start and an end (either may be missing) that gives a pandas table with ``date``,
``ticker`` and any of the columns of bars, or a wide one with columns like ``close|AAA``. Spark asks it in tasks, one for
each group of tickers, and again if it fails. Filters on ticker and date reach the provider: tickers that a filter leaves
out aren't asked for, and dates narrow what is asked. Options: ``provider``, its place as ``module:function``;
``tickers``, with commas; ``start`` and ``end`` as dates; ``group``, tickers of a task; ``retries`` and ``wait``, seconds
before a retry, which double. A ticker of which nothing came has one row with ``missing`` set and no date, if the option
``report`` is true; ``split`` tells the two apart.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from datetime import date, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

COLUMNS = ("open", "high", "low", "close", "adj_close", "volume")
FORMAT = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume long, missing boolean"
ARROW = pa.schema([("date", pa.date32()), ("ticker", pa.string()), *((c, pa.int64() if c == "volume" else pa.float64()) for c in COLUMNS), ("missing", pa.bool_())])


def long_bars(frame: pd.DataFrame) -> pd.DataFrame:
    """Bars of a provider's table, long or wide, tickers in upper case; an adjusted close that is missing is the close, and
    rows with neither are left out."""
    frame = frame.copy()
    if any("|" in str(c) for c in frame.columns):
        tickers = sorted({c.split("|", 1)[1] for c in frame.columns if "|" in str(c)})
        frame = pd.concat([pd.DataFrame({"date": frame["date"], "ticker": t, **{f: frame[f"{f}|{t}"] for f in COLUMNS if f"{f}|{t}" in frame.columns}}) for t in tickers])
    frame.columns = [str(c).lower().replace(" ", "_") for c in frame.columns]
    for column in COLUMNS:
        if column not in frame.columns:
            frame[column] = None
    frame["adj_close"] = frame["adj_close"].astype(float).fillna(frame["close"].astype(float))
    frame = frame.dropna(subset=["date", "ticker", "adj_close"])
    volume = frame["volume"].astype("Float64").astype("Int64")
    return frame.assign(date=pd.to_datetime(frame["date"]).dt.date, ticker=frame["ticker"].str.upper(), volume=volume)[["date", "ticker", *COLUMNS]]


@dataclass(frozen=True)
class Asked(InputPartition):
    tickers: tuple[str, ...]
    start: date | None
    end: date | None


class PriceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.provider = options["provider"]
        tickers = (t.strip().upper() for t in options.get("tickers", "").split(","))
        self.tickers = tuple(dict.fromkeys(t for t in tickers if t))
        self.start, self.end = (date.fromisoformat(options[k]) if options.get(k) else None for k in ("start", "end"))
        self.group, self.retries, self.wait = int(options.get("group", 50)), int(options.get("retries", 3)), float(options.get("wait", 1))
        self.report = str(options.get("report", "false")).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows what is asked for. Filters on tickers are met wholly, those on dates too; Spark applies the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "ticker" and isinstance(f, EqualTo | In):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.tickers = tuple(t for t in self.tickers if t in values)
            elif column == "date" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                low = f.value + timedelta(isinstance(f, GreaterThan))
                self.start = low if self.start is None else max(self.start, low)
                self.report = False
            elif column == "date" and isinstance(f, LessThan | LessThanOrEqual):
                high = f.value + timedelta(isinstance(f, LessThanOrEqual))
                self.end = high if self.end is None else min(self.end, high)
                self.report = False
            else:
                yield f

    def partitions(self) -> list[Asked]:
        if self.start is not None and self.end is not None and self.start >= self.end:
            return [Asked((), None, None)]
        asked = Asked((), self.start, self.end)
        return [replace(asked, tickers=self.tickers[i : i + self.group]) for i in range(0, len(self.tickers), self.group)] or [asked]

    def read(self, partition: Asked) -> Iterator[pa.RecordBatch]:
        if not partition.tickers:
            return
        module, name = self.provider.split(":")
        provider = getattr(importlib.import_module(module), name)
        for tried in range(self.retries + 1):
            try:
                bars = long_bars(provider(list(partition.tickers), partition.start, partition.end))
                break
            except Exception:
                if tried == self.retries:
                    raise
                time.sleep(self.wait * 2**tried)
        bars = bars[bars["ticker"].isin(partition.tickers)]
        if partition.start is not None:
            bars = bars[bars["date"] >= partition.start]
        if partition.end is not None:
            bars = bars[bars["date"] < partition.end]
        bars = bars.assign(missing=False)
        if self.report and (lacking := sorted(set(partition.tickers) - set(bars["ticker"]))):
            bars = pd.concat([bars, pd.DataFrame({"ticker": lacking, "missing": True})])
        yield from pa.Table.from_pandas(bars, ARROW, preserve_index=False).to_batches()


class PriceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prices"

    def schema(self) -> str:
        return FORMAT

    def reader(self, schema) -> PriceReader:
        return PriceReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PriceSource)


def split(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bars, and the tickers of which nothing came."""
    return frame.where("NOT missing").drop("missing"), frame.where("missing").select("ticker")
