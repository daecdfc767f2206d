"""Leak-free supervised splits: targets, chronological cuts, scaling by training rows only, and sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.features import LAGS, features, names
from ..functions.windows import by_date, by_ticker

TINY = 1e-12
LEAST_TRAIN = 50


def usable(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def with_targets(frame: DataFrame, target: str = "return") -> DataFrame:
    """Adds ``target``, the next return or price, ``target_date``, ``prev_price`` and ``actual_price``; a ticker's last
    row has none."""
    following = F.lead("price").over(by_date())
    value = F.try_divide(following, F.col("price")) - 1 if target == "return" else following
    return frame.withColumns({"target": value, "target_date": F.lead("date").over(by_date()), "prev_price": F.col("price"), "actual_price": following})


def numbered(frame: DataFrame, columns: list[str], train: float, window: int | None = None) -> DataFrame:
    """Rows with everything finite, numbered from 0, with ``n`` of their ticker, the cut and ``is_train``."""
    fine = reduce(lambda a, b: a & b, (usable(F.col(c)) for c in (*columns, "target", "price")))
    rows = frame.where(fine).withColumns({"seq_no": F.row_number().over(by_date()) - 1, "n": F.count("*").over(by_ticker())})
    cut = F.ceil(F.col("n") * train)
    if window:
        cut = F.greatest(cut, F.lit(window + 1))
    return rows.withColumn("cut", cut.cast("long")).withColumn("is_train", F.col("seq_no") < F.col("cut"))


def failures(rows: DataFrame, tickers: DataFrame, least: int = LEAST_TRAIN) -> DataFrame:
    """``ticker`` and ``reason`` of the tickers that can't be split; they don't stop the others."""
    sizes = rows.groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.col("is_train").cast("long")).alias("n_train"))
    reason = F.when(F.col("n").isNull(), "no usable rows").when(F.col("n_train") < least, "too few training rows").when(F.col("n_train") >= F.col("n"), "no test rows")
    return tickers.select("ticker").distinct().join(sizes, "ticker", "left").withColumn("reason", reason).where("reason IS NOT NULL").select("ticker", "reason")


def scaled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean, by its population deviation, both over the ticker's training rows; a deviation of next
    to nothing counts as 1. ``y_mean`` and ``y_scale`` undo the target's."""
    def of(c: str) -> tuple[Column, Column]:
        seen = F.when(F.col("is_train"), F.col(c))
        deviation = F.stddev_pop(seen).over(by_ticker())
        return F.avg(seen).over(by_ticker()), F.when(deviation > TINY, deviation).otherwise(1.0)

    stats = {c: of(c) for c in (*columns, "target")}
    out = {f"{c}_scaled": (F.col(c) - m) / s for c, (m, s) in stats.items()}
    return rows.withColumns(out | {"y_mean": stats["target"][0], "y_scale": stats["target"][1]})


def unscaled(column: str) -> Column:
    return F.col(column) * F.col("y_scale") + F.col("y_mean")


def min_max(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_unit``: 0 to 1 over the training rows, not clipped beyond them."""
    seen = F.when(F.col("is_train"), F.col(column))
    low, high = F.min(seen).over(by_ticker()), F.max(seen).over(by_ticker())
    return rows.withColumn(f"{column}_unit", (F.col(column) - low) / F.when(high - low > TINY, high - low).otherwise(1.0))


def splits(prices: DataFrame, train: float, target: str = "return", lags: int = LAGS, window: int | None = None, least: int = LEAST_TRAIN) -> tuple[DataFrame, DataFrame]:
    """The scaled rows of all tickers that can be split, and the failures."""
    columns = names(lags)
    rows = numbered(with_targets(features(prices, lags), target), columns, train, window)
    failed = failures(rows, prices, least)
    fine = rows.join(failed.select("ticker"), "ticker", "left_anti")
    return scaled(fine, columns), failed


def sequences(rows: DataFrame, columns: list[str], window: int) -> DataFrame:
    """Adds ``x``, the columns of the last ``window`` rows, oldest first; rows with fewer before them are left out."""
    listed = F.collect_list(F.array(*columns)).over(by_date().rowsBetween(-(window - 1), 0))
    return rows.withColumn("x", listed).where(F.size("x") == window)


def lagged(prices: DataFrame, length: int) -> DataFrame:
    """``x``, the ``length`` prices before each row, and ``y``, its own."""
    listed = F.collect_list("price").over(by_date().rowsBetween(-length, -1))
    return prices.withColumn("x", listed).where(F.size("x") == length).select("date", "ticker", "x", F.col("price").alias("y"))


def validation(rows: DataFrame, fraction: float) -> DataFrame:
    """Marks the last part of each ticker's training rows as ``is_validation``: at least one row, and never all."""
    n = F.col("cut")
    first = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * (1 - fraction))))
    return rows.withColumn("is_validation", F.col("is_train") & (F.col("seq_no") >= first))


def reconstructed(raw: Column, target: str = "return") -> Column:
    """A price from a predicted target."""
    return F.col("prev_price") * (1 + raw) if target == "return" else raw
