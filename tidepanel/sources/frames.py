"""Long and wide panels, and the row-major frame that results are sent as."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F


def to_long(wide: DataFrame, value: str = "price", index: str = "date") -> DataFrame:
    """A column for each ticker becomes rows; nulls are left out."""
    tickers = [c for c in wide.columns if c != index]
    return wide.unpivot([index], tickers, "ticker", value).dropna(subset=[value])


def to_wide(long: DataFrame, tickers: Sequence[str] | None = None, value: str = "price", index: str = "date") -> DataFrame:
    """Rows become a column for each ticker, by date. Naming the tickers saves a pass to find them."""
    grouped = long.groupBy(index)
    pivot = grouped.pivot("ticker", list(tickers)) if tickers is not None else grouped.pivot("ticker")
    return pivot.agg(F.first(value, ignorenulls=True)).orderBy(index)


def aligned(long: DataFrame, value: str = "price", by: Sequence[str] = ()) -> DataFrame:
    """The shared calendar, of each group of ``by``: tickers with any value at all, on dates on which each of them has one."""
    some = long.where(F.col(value).isNotNull())
    tickers = some.groupBy(*by).agg(F.count_distinct("ticker").alias("tickers"))
    found = some.groupBy(*by, "date").agg(F.count_distinct("ticker").alias("n"))
    if by:
        whole = found.join(tickers, list(by)).where("n = tickers").select(*by, "date")
    else:
        whole = found.join(F.broadcast(tickers), F.col("n") == F.col("tickers"), "left_semi")
    return some.join(whole, [*by, "date"], "left_semi")


def latest(long: DataFrame, value: str = "price") -> DataFrame:
    """The last value of each ticker that is not null: ``ticker``, ``date``, the value."""
    some = long.where(F.col(value).isNotNull())
    return some.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by(value, "date").alias(value))


def points(wide: DataFrame, column: str, index: str = "date") -> DataFrame:
    """One column of a panel as points ``date``, ``value``, in order, those without a value left out."""
    return wide.select(index, F.col(f"`{column}`").alias("value")).dropna(subset=["value"]).orderBy(index)


def ranked_weights(weights: DataFrame, strategy: str, least: float = 0.0) -> DataFrame:
    """A strategy's weights, the largest first; those no larger than ``least`` either way are left out."""
    own = weights.where((F.col("strategy") == strategy) & (F.abs("weight") > least))
    return own.select("ticker", "weight").orderBy(F.desc("weight"), "ticker")


def finite(column: str):
    """The column, null where it is not a finite number."""
    x = F.col(column)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


@dataclass(frozen=True)
class Frame:
    """A result on the wire: labels of rows, names of columns, and the values row by row."""

    index: list[str]
    columns: list[str]
    data: list[list[float | None]]

    def __post_init__(self):
        if len(self.index) != len(self.data) or any(len(row) != len(self.columns) for row in self.data):
            raise ValueError("a frame has a label for each row and a value for each column")

    @classmethod
    def of(cls, frame: DataFrame, index: str = "date") -> Frame:
        """Collects a result: a panel as wide as its tickers, never the long relation behind it."""
        columns = [c for c in frame.columns if c != index]
        rows = frame.orderBy(index).select(index, *columns).collect()
        return cls([label(r[0]) for r in rows], columns, [[number(x) for x in r[1:]] for r in rows])

    def long(self, spark: SparkSession, value: str = "value") -> DataFrame:
        rows = [(i, c, x) for i, row in zip(self.index, self.data) for c, x in zip(self.columns, row)]
        return spark.createDataFrame(rows, f"date string, ticker string, {value} double").withColumn("date", F.to_date("date")).dropna(subset=[value])


def label(x: Any) -> str:
    return x.isoformat() if isinstance(x, date | datetime) else str(x)


def number(x: Any) -> float | None:
    return None if x is None or not math.isfinite(x) else float(x)
