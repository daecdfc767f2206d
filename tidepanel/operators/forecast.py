"""Forecast backends: rows ``ticker, date, predicted, actual`` in prices, whatever the target that was learnt."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.features import LAGS, names
from ..functions.returns import simple
from ..functions.windows import by_date
from ..shared import stored
from . import boosting
from .splits import reconstructed, splits, unscaled, validation

LEAST_OBSERVATIONS = 200


@dataclass(frozen=True)
class Params:
    train: float = 2 / 3
    target: str = "return"
    lags: int = LAGS
    pooled: bool = True
    trees: boosting.Settings = boosting.Settings()


def naive(prices: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """The random walk: each test row is predicted by the price before it."""
    whole = Window.partitionBy("ticker")
    rows = prices.withColumns({"seq": F.row_number().over(by_date()) - 1, "n": F.count("*").over(whole), "predicted": F.lag("price").over(by_date())})
    tested = rows.where((F.col("n") >= LEAST_OBSERVATIONS) & (F.col("seq") >= F.ceil(F.col("n") * params.train)))
    failed = rows.where(F.col("n") < LEAST_OBSERVATIONS).select("ticker", F.lit("too few observations").alias("reason")).distinct()
    return tested.select("ticker", "date", "predicted", F.col("price").alias("actual")), failed


def columns_of(lags: int) -> list[str]:
    return [f"{n}_scaled" for n in names(lags)]


def boosted(prices: DataFrame, params: Params = Params(), progress: Callable[[float], None] = lambda share: None) -> tuple[DataFrame, DataFrame]:
    """Gradient-boosted trees over the features, all tickers in one model or a model for each; the last 15 % of the
    training rows stop the growth. Targets are scaled by ticker, so tickers can be pooled. With a model for each, all are
    fitted in one job, and what a ticker's fit raises is its reason among the failures."""
    rows, failed = splits(prices, params.train, params.target, params.lags)
    rows = stored(validation(rows, 0.15), "splits")
    columns, keep = columns_of(params.lags), ["prev_price", "y_mean", "y_scale", "actual_price"]
    if params.pooled:
        fitted = model(rows, params, progress)
        told = boosting.predict(rows.where("NOT is_train").select("ticker", "target_date", *keep, *columns), columns, fitted)
    else:
        told = stored(boosting.fit_each(rows, columns, params.trees, date="target_date", keep=keep), "forecasts")
        failed = failed.unionByName(told.where("error IS NOT NULL").select("ticker", F.col("error").alias("reason")))
        told = told.where("error IS NULL")
        progress(1.0)
    price = reconstructed(unscaled("raw"), params.target)
    return told.select("ticker", F.col("target_date").alias("date"), price.alias("predicted"), F.col("actual_price").alias("actual")), failed


def model(rows: DataFrame, params: Params = Params(), progress: Callable[[float], None] = lambda share: None) -> boosting.Model:
    """The pooled model of split rows."""
    return boosting.fit(rows.where("is_train"), columns_of(params.lags), params.trees, key=("ticker", "target_date"), progress=progress)


def importances(rows: DataFrame, params: Params = Params()) -> dict[str, float]:
    """The shares of the features in the cuts of the trees; they sum to 1."""
    return dict(zip(names(params.lags), model(rows, params).importances().tolist()))


@dataclass(frozen=True)
class Backend:
    name: str
    scope: str
    needs: str | None
    run: Callable | None

    @property
    def available(self) -> bool:
        return self.run is not None and (self.needs is None or importlib.util.find_spec(self.needs) is not None)


BACKENDS = {b.name: b for b in (Backend("naive", "ticker", None, naive), Backend("gbt", "universe", "numpy", boosted), Backend("torch_lstm", "universe", "torch", None), Backend("keras_lstm", "ticker", "keras", None))}


def forecast(prices: DataFrame, backend: str = "naive", params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """The forecast and the tickers that failed, with the reason."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend: {backend}")
    if not BACKENDS[backend].available:
        raise ValueError(f"backend {backend} is not available here")
    return BACKENDS[backend].run(prices, params)


def returns_of(forecast: DataFrame) -> DataFrame:
    """Predicted and actual prices with the simple returns of each along a ticker's dates."""
    return forecast.select("ticker", "date", "predicted", "actual", simple("predicted").alias("predicted_return"), simple("actual").alias("actual_return"))


def outer_aligned(forecast: DataFrame) -> DataFrame:
    """A row for each date of any ticker and each ticker, null where a ticker has no forecast: tickers with different
    histories line up by date. Of rows with one key the first counts. As large as the panel that it fills."""
    rows = forecast.groupBy("date", "ticker").agg(F.first("predicted").alias("predicted"), F.first("actual").alias("actual"))
    grid = rows.select("date").distinct().crossJoin(rows.select("ticker").distinct())
    return grid.join(rows, ["date", "ticker"], "left").select("date", "ticker", "predicted", "actual")
