"""The calls that users of the engine make, one for each analytic route: validated, and lazy up to their last step."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.returns import simple_returns
from ..operators import backtest as bt, forecast as fc, metrics as fm, performance as perf
from ..operators.optimize import FREE, STRATEGIES, Constraints, efficient_set, optimize
from ..sources.frames import Frame, aligned, to_wide
from ..sources.market import Market
from ..sources.store import PriceStore
from . import sql


class PriceLevels(ValueError):
    """What was given as returns looks like prices."""


def refuse_prices(returns: DataFrame) -> DataFrame:
    mean = returns.agg(F.avg(F.abs("return"))).first()[0]
    if mean is not None and mean > 1:
        raise PriceLevels("returns of more than 1 on average: these are prices")
    return returns


def optimized(returns: DataFrame, strategies: Iterable[str] = tuple(STRATEGIES), constraints: Constraints = FREE, rf: float = 0.0) -> DataFrame:
    if constraints.max_turnover is not None and not constraints.previous:
        raise ValueError("a turnover limit needs the previous weights")
    if wrong := constraints.out_of_range():
        raise ValueError("; ".join(wrong))
    return optimize(refuse_prices(aligned(returns, "return")), strategies, constraints, rf)


def evaluated(returns: DataFrame, weights: DataFrame, rf: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Performance and growth of 1 of portfolios; tickers that either side lacks are left aside."""
    series = perf.portfolio_returns(returns, weights.where("ticker IS NOT NULL"))
    return perf.performance(series, rf=rf), series.select("date", "strategy", perf.growth().alias("growth"))


def efficient(returns: DataFrame, constraints: Constraints = FREE, points: int = 40, rf: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The efficient set and its point of the best Sharpe ratio."""
    all_points = efficient_set(returns, constraints, points, rf)
    return all_points, all_points.orderBy(F.desc("sharpe"), "point").limit(1)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """The jobs of what runs inside, in this thread, can be ended by ``cancel`` from another."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the jobs that run under a tag; what waits for them raises."""
    spark.sparkContext.cancelJobsWithTag(tag)


@dataclass(frozen=True)
class Outcome:
    forecast: DataFrame
    failures: DataFrame
    metrics: DataFrame
    weights: DataFrame
    performance: DataFrame
    chosen: DataFrame
    chosen_weights: DataFrame


def pipeline(prices: DataFrame, backend: str = "naive", params: fc.Params = fc.Params(), strategies: Iterable[str] = tuple(STRATEGIES), tolerance: float = 0.5, rf: float = 0.0, constraints: Constraints = FREE) -> Outcome:
    """Forecasts prices, builds portfolios on the predicted returns, scores them on the actual ones, and picks by risk."""
    forecast, failures = fc.forecast(prices, backend, params)
    forecast = forecast.persist()
    of = lambda c: simple_returns(aligned(forecast.select("date", "ticker", F.col(c).alias("price"))))
    weights = optimize(of("predicted"), strategies, constraints, rf).persist()
    table, _ = evaluated(of("actual"), weights, rf)
    chosen = perf.by_risk(table, tolerance)
    picked = weights.where("ticker IS NOT NULL").join(F.broadcast(chosen.select("strategy")), "strategy", "left_semi")
    return Outcome(forecast, failures, fm.metrics(forecast), weights, table, chosen, perf.normalised(picked))


def backtested(returns: DataFrame, strategies: Iterable[str] = tuple(STRATEGIES), config: bt.Config = bt.Config(), constraints: Constraints = FREE, rf: float = 0.0) -> tuple[bt.Result, DataFrame]:
    result = bt.backtest(returns, strategies, config, constraints, rf)
    return result, bt.summary(result, config, rf)


def coverage(store: PriceStore, max_gap_days: int = 5) -> dict[str, DataFrame | int]:
    if not 1 <= max_gap_days <= 365:
        raise ValueError("gaps of 1 to 365 days can be asked for")
    bars = store.scan()
    return {"tickers": sql.coverage(bars).orderBy("ticker"), "gaps": sql.gaps(bars, max_gap_days).orderBy(F.desc("gap_days"), "ticker", "gap_start"), "vintages": sql.vintages(bars).orderBy("ingested_at"), "total_rows": bars.count()}


def ask(store: PriceStore, query: str, limit: int = 1000) -> tuple[DataFrame, bool]:
    """Reads the store with SQL, as the view ``prices``."""
    store.view("prices")
    return sql.guarded(store.spark, query, limit)


def panel(market: Market, tickers: Sequence[str], start: date, end: date, kind: str = "prices") -> Frame:
    frame = market.prices(tickers, start, end) if kind == "prices" else market.returns(tickers, start, end)
    return Frame.of(to_wide(frame, sorted({t.upper() for t in tickers}), "price" if kind == "prices" else "return"))


RUNS = "run_id string, kind string, params map<string,string>, metrics map<string,double>, tags map<string,string>, at timestamp"


def track(spark: SparkSession, path: str, kind: str, params: dict, metrics: dict[str, float], tags: dict[str, str] | None = None, tables: dict[str, DataFrame] | None = None) -> str:
    """Appends a run to the table of runs, and its tables beside it."""
    run = uuid.uuid4().hex
    clean = {"".join(c if c.isalnum() or c in "_./ -" else "_" for c in k): float(v) for k, v in metrics.items() if v is not None}
    row = [(run, kind, {k: json.dumps(v, default=str) for k, v in params.items()}, clean, tags or {})]
    spark.createDataFrame(row, RUNS.rpartition(",")[0]).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{path}/runs")
    for name, table in (tables or {}).items():
        table.write.mode("append").parquet(f"{path}/tables/{name}/run_id={run}")
    return run


def runs(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    return spark.read.schema(RUNS).parquet(f"{path}/runs").orderBy(F.desc("at")).limit(limit)


def save_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)
