"""Performance of return series, and portfolios as sums of weighted returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PERIODS = 252


def growth(by: str = "strategy", value: str = "return") -> Column:
    """The compounded value of 1 along the dates."""
    return F.product(1 + F.col(value)).over(Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """``date, strategy, return`` from ``date, ticker, return`` and ``strategy, ticker, weight``, matched by ticker."""
    return returns.join(weights, "ticker").groupBy("date", "strategy").agg(F.sum(F.col("return") * F.col("weight")).alias("return"))


def performance(series: DataFrame, by: str = "strategy", rf: float = 0.0, periods: int = PERIODS) -> DataFrame:
    """Annual return and volatility, Sharpe and Sortino ratio and largest drawdown; series without values have no row.

    The peak that a drawdown is measured from starts at the first compounded value.
    """
    rows = series.where(F.col("return").isNotNull()).withColumn("growth", growth(by))
    peak = F.max("growth").over(Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("drawdown", F.try_divide("growth", peak) - 1)
    stats = rows.groupBy(by).agg(
        (F.avg("return") * periods).alias("annual_return"),
        (F.coalesce(F.stddev_samp("return"), F.lit(0.0)) * F.sqrt(F.lit(periods))).alias("annual_volatility"),
        (F.sqrt(F.avg(F.pow(F.least(F.col("return"), F.lit(0.0)), F.lit(2)))) * F.sqrt(F.lit(periods))).alias("downside"),
        F.min("drawdown").alias("max_drawdown"),
    )
    excess = F.col("annual_return") - rf
    ratio = lambda by: F.when(F.col(by) > 0, F.try_divide(excess, F.col(by))).otherwise(0.0)
    return stats.select(by, "annual_return", "annual_volatility", ratio("annual_volatility").alias("sharpe"), ratio("downside").alias("sortino"), "max_drawdown")


def by_risk(table: DataFrame, tolerance: float, by: str = "strategy") -> DataFrame:
    """The row at the place of the tolerance, 0 to 1, among all by volatility; ties go by name. One row a strategy."""
    place = Window.orderBy("annual_volatility", by)
    ranked = table.withColumns({"place": F.row_number().over(place), "n": F.count("*").over(Window.partitionBy())})
    wanted = F.bround(F.lit(min(1.0, max(0.0, tolerance))) * (F.col("n") - 1)) + 1
    return ranked.where(F.col("place") == wanted).drop("place", "n")


def normalised(weights: DataFrame) -> DataFrame:
    """Weights of each strategy scaled to sum to 1."""
    return weights.withColumn("weight", F.try_divide("weight", F.sum("weight").over(Window.partitionBy("strategy"))))


def top(table: DataFrame, k: int, column: str = "sharpe", by: str = "strategy") -> DataFrame:
    return table.orderBy(F.desc(column), by).limit(k)
