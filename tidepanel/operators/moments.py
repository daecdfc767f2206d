"""Means and covariances of groups of returns, as rows of matrices: what solvers get instead of returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..sources.frames import aligned
from .covariance import covariance, gerber, means, products


def moments(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``i``, ``j``, ``cov``, ``mean`` (of i), ``dates``: over the dates of a group on which all its tickers have a
    return."""
    whole = aligned(returns, "return", by)
    dates = whole.groupBy(*by).agg(F.count_distinct("date").alias("dates"))
    mean = means(whole, by).withColumnRenamed("ticker", "i")
    out = covariance(whole, by).join(mean, [*by, "i"])
    out = out.join(dates, list(by)) if by else out.crossJoin(F.broadcast(dates))  # one row
    return out.select(*by, "i", "j", "cov", "mean", "dates")


def comoves(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``i``, ``j``, ``gerber``."""
    return gerber(returns, by=by).withColumnRenamed("cov", "gerber")


def window_moments(rows: DataFrame, lookback: int, every: int, last: int) -> DataFrame:
    """``k``, ``i``, ``j``, ``cov``, ``mean``, ``dates`` of the window of ``lookback`` dates before each ``every``-th date, for
    the rows of a calendar numbered by ``idx``, whose tickers have all dates.

    Dates fall into blocks of ``every``, each cut once more where windows end. A piece is multiplied once, and the sums
    of pieces are added up for each window that holds them."""
    whole, rest = divmod(lookback, every)
    centre = rows.groupBy("ticker").agg(F.avg("return").alias("centre"))
    block = F.floor(F.col("idx") / F.lit(float(every))).cast("int")
    tail = (F.col("idx") % every >= rest).cast("int")
    pieces = rows.join(centre, "ticker").select((block * 2 + tail).alias("piece"), "date", "ticker", (F.col("return") - F.col("centre")).alias("apart"))

    def windows(frame: DataFrame) -> DataFrame:
        block, first = F.floor(F.col("piece") / 2).cast("int"), F.lit(whole) - F.when(F.col("piece") % 2 == 1, 1).otherwise(0)
        low, high = F.greatest(F.lit(0), block - first), F.least(F.lit((last - lookback) // every), block)
        return frame.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))

    sums = windows(pieces.groupBy("piece", "ticker").agg(F.sum("apart").alias("sum"))).groupBy("k", "ticker").agg(F.sum("sum").alias("sum"))
    both = windows(products(pieces, "apart", ("piece",))).groupBy("k", "i", "j").agg(F.sum("product").alias("product"), F.sum("dates").alias("dates"))
    of = lambda end: sums.select("k", F.col("ticker").alias(end), F.col("sum").alias(f"sum_{end}"))
    both = both.join(of("i"), ["k", "i"]).join(of("j"), ["k", "j"]).join(centre.withColumnRenamed("ticker", "i"), "i")
    cov = F.try_divide(F.col("product") - F.col("sum_i") * F.col("sum_j") / F.col("dates"), F.col("dates") - 1)
    return both.select("k", "i", "j", cov.alias("cov"), (F.col("centre") + F.col("sum_i") / F.col("dates")).alias("mean"), "dates")
