"""Deterministic prices for tests and offline use: a geometric walk for each ticker, seeded by its name."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Yearly drift and volatility, trading days, start price.
DRIFT, VOLATILITY, DAYS, BASE = 0.08, 0.24, 252, 100.0


def seed(ticker: str) -> int:
    return int.from_bytes(hashlib.sha256(ticker.upper().encode()).digest()[:8], "big")


def synthetic_prices(spark: SparkSession, tickers: Sequence[str], start: date, end: date, base: float = BASE) -> DataFrame:
    """``date, ticker, price`` on the business days of ``start <= date < end``; each ticker is made in a group of its own."""
    names = spark.createDataFrame([(t.upper(),) for t in dict.fromkeys(tickers)], "ticker string")
    days = names.select("ticker", F.explode(F.sequence(F.lit(start), F.date_sub(F.lit(end), 1))).alias("date")).where(F.weekday("date") < 5)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        own = seed(group["ticker"].iloc[0])
        shocks = np.random.Generator(np.random.PCG64(own)).normal(DRIFT / DAYS, VOLATILITY / np.sqrt(DAYS), len(group))
        return group.assign(price=base * (0.5 + own % 1000 / 500) * np.cumprod(1 + shocks))[["date", "ticker", "price"]]

    return days.groupBy("ticker").applyInPandas(walk, "date date, ticker string, price double")
