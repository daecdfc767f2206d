"""Forecast metrics by ticker, over rows ``ticker, date, predicted, actual``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.windows import by_date

ALMOST_ZERO = 1e-8


def metrics(forecast: DataFrame) -> DataFrame:
    """One row for each ticker; a measure that is not defined is null."""
    p, a = F.col("predicted"), F.col("actual")
    rows = forecast.withColumn("before", F.lag("actual").over(by_date()))
    called = F.signum(p - F.col("before")), F.signum(a - F.col("before"))
    rows = rows.withColumns({"error": p - a, "agrees": F.when((called[0] != 0) & (called[1] != 0), (called[0] == called[1]).cast("double"))})
    later = F.col("before").isNotNull()
    by = rows.groupBy("ticker").agg(
        F.count("*").alias("observations"),
        F.sqrt(F.avg(F.pow("error", F.lit(2)))).alias("rmse"),
        F.avg(F.abs("error")).alias("mae"),
        F.sum(F.pow("error", F.lit(2))).alias("sse"),
        (F.var_pop(a) * F.count("*")).alias("sst"),
        (F.avg(F.abs(F.try_divide(a - p, F.when(a == 0, ALMOST_ZERO).otherwise(a)))) * 100).alias("mape"),
        F.avg("agrees").alias("directional_accuracy"),
        F.try_divide(F.avg(F.when(later, F.abs("error"))), F.avg(F.when(later, F.abs(F.col("before") - a)))).alias("mase"),
        F.avg(a).alias("mean_actual"),
    )
    score = 100 * (1 - F.col("rmse") / F.when(F.col("mean_actual") == 0, ALMOST_ZERO).otherwise(F.col("mean_actual")))
    return by.select(
        "ticker", "observations", "rmse", "mae", (1 - F.try_divide("sse", "sst")).alias("r2"), "mape", "directional_accuracy", "mase",
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("accuracy"),
    )


def summary(by_ticker: DataFrame) -> DataFrame:
    """Mean, least and largest of each measure over the tickers that have it."""
    measures = [c for c in by_ticker.columns if c not in ("ticker", "observations")]
    long = by_ticker.unpivot(["ticker"], measures, "metric", "value")
    fine = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return long.withColumn("value", fine).groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
