"""Returns of long price frames. Null in, null out; the first row of a ticker has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .windows import by_date



def simple(price: str = "price") -> Column:
    return F.try_divide(F.col(price), F.lag(price).over(by_date())) - 1


def simple_returns(prices: DataFrame, price: str = "price") -> DataFrame:
    return prices.withColumn("return", simple(price)).where(F.col("return").isNotNull()).select("date", "ticker", "return")


def log_returns(prices: DataFrame, price: str = "price") -> DataFrame:
    ratio = F.try_divide(F.col(price), F.lag(price).over(by_date()))
    return prices.withColumn("ratio", ratio).where(F.col("ratio") > 0).select("date", "ticker", F.ln("ratio").alias("return"))
