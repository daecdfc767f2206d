"""Walk-forward backtests as joins and windows.

Between two trades nothing depends on the day before but growth: with target weights w and each asset's growth G since
the trade, the portfolio is worth V = sum(wG), earns V / V_before - 1, and holds wG / V. So drift, gross returns, turnover
and costs of all strategies and all holding periods are window aggregates; only solvers run in groups, one for each
rebalance, over means and covariances that windows which overlap share the sums of. Where turnover is limited a solution
depends on the holdings before it, and each strategy walks through its rebalances in one group.

What later steps read more than once, the rows of the shared calendar, the targets and the days that they are held, is
written once as a table in the shared folder, so no plan holds another's.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..shared import drop, stored
from ..sources.frames import aligned
from .moments import comoves, window_moments
from .optimize import BY_GERBER, BY_RETURNS, FREE, STRATEGIES, Constraints, Known, optimize, solve, square
from .performance import PERIODS, growth, performance


@dataclass(frozen=True)
class Config:
    lookback: int = 252
    every: int = 21
    cost_bps: float = 10.0
    periods: int = PERIODS


@dataclass(frozen=True)
class Result:
    """``daily``: date, strategy, gross, cost, return. ``trades``: date, strategy, turnover, cost, traded. ``targets``:
    date, strategy, ticker, weight. ``warnings``: date, strategy, warning, one for each thing that a solver told. They
    read stored tables, which are there until ``release``."""

    daily: DataFrame
    trades: DataFrame
    targets: DataFrame
    warnings: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        drop(*self.kept)


def indexed(returns: DataFrame) -> DataFrame:
    """Stored rows of the shared calendar with ``idx``, the date's number from 0. Only dates are numbered in one window."""
    given = stored(returns.select("date", "ticker", "return"), "returns")
    whole = aligned(given, "return")
    dates = whole.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)
    out = stored(whole.join(dates, "date"), "panel")
    drop(given)
    return out


def estimation(rows: DataFrame, c: Config, last: int) -> DataFrame:
    """Each row once for each rebalance ``k`` whose window, the ``lookback`` dates before it, holds its date."""
    low = F.greatest(F.lit(0), F.floor((F.col("idx") - c.lookback) / F.lit(float(c.every))) + 1).cast("int")
    high = F.least(F.lit((last - c.lookback) // c.every), F.floor(F.col("idx") / F.lit(float(c.every)))).cast("int")
    return rows.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))


def equal_weights(windows: DataFrame) -> DataFrame:
    of = Window.partitionBy("k")
    names = windows.select("k", "ticker").distinct()
    return names.select("k", F.lit("Equal").alias("strategy"), "ticker", (1.0 / F.count("*").over(of)).alias("weight"))


def inverse_variance(windows: DataFrame) -> DataFrame:
    own = windows.groupBy("k", "ticker").agg(F.var_samp("return").alias("var")).withColumn("inverse", F.try_divide(F.lit(1.0), "var"))
    return own.select("k", F.lit("InverseVariance").alias("strategy"), "ticker", (F.col("inverse") / F.sum("inverse").over(Window.partitionBy("k"))).alias("weight"))


def walk(rows: DataFrame, targets: DataFrame, c: Config, messages: DataFrame | None = None) -> Result:
    """Holds the stored targets ``k, strategy, ticker, weight``. A strategy without targets at a rebalance holds on; one
    without any at the first is left out. ``messages``: ``k, strategy, warning``."""
    held = rows.where(F.col("idx") >= c.lookback).withColumn("k", F.floor((F.col("idx") - c.lookback) / F.lit(float(c.every))).cast("int"))
    first = targets.where("k = 0").select("strategy").distinct()
    targets = targets.join(first, "strategy", "left_semi")
    calendar = held.groupBy("k").agg(F.min("date").alias("date"), F.min("idx").alias("idx"))
    solved = targets.select("k", "strategy").distinct().withColumn("solved", F.col("k"))
    # For each rebalance and strategy the last one at which it had targets: a row a rebalance.
    names = F.array(*map(F.lit, sorted(r.strategy for r in first.collect())))  # as many as there are strategies
    every = calendar.withColumn("strategy", F.explode(names))
    trades = every.join(solved, ["k", "strategy"], "left").withColumn("segment", F.last("solved", ignorenulls=True).over(Window.partitionBy("strategy").orderBy("k")))
    days = held.join(trades.select("k", "strategy", "segment"), "k").join(targets.withColumnRenamed("k", "segment"), ["segment", "strategy", "ticker"])
    line = Window.partitionBy("strategy", "segment", "ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("held", F.col("weight") * F.product(1 + F.col("return")).over(line))
    days = stored(days.select("strategy", "segment", "k", "date", "idx", "ticker", "weight", "held"), "days")
    worth = days.groupBy("strategy", "segment", "k", "date", "idx").agg(F.sum("held").alias("worth"), F.sum("weight").alias("put_in"))
    along = Window.partitionBy("strategy", "segment").orderBy("idx")
    gross = worth.withColumn("gross", F.coalesce(F.try_divide("worth", F.lag("worth").over(along)), F.try_divide("worth", "put_in")) - 1)
    # What is held at the end of a segment meets the next segment's targets.
    order = Window.partitionBy("strategy").orderBy("segment")
    segments = worth.groupBy("strategy", "segment").agg(F.max("idx").alias("idx")).withColumn("next", F.lead("segment").over(order))
    ends = days.join(segments, ["strategy", "segment", "idx"]).join(worth.select("strategy", "segment", "idx", "worth"), ["strategy", "segment", "idx"])
    drifted = ends.select("strategy", F.col("next").alias("k"), "ticker", F.when(F.abs("worth") > 1e-12, F.col("held") / F.col("worth")).otherwise(F.col("held")).alias("before")).where("k IS NOT NULL")
    moves = targets.join(drifted, ["strategy", "k", "ticker"], "full_outer")
    turnover = moves.groupBy("strategy", "k").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))).alias("turnover"))
    trades = trades.join(turnover, ["strategy", "k"], "left").withColumn("turnover", F.when(F.col("solved").isNotNull(), F.col("turnover")).otherwise(0.0))
    trades = trades.select("strategy", "k", "date", "turnover", (F.col("turnover") * c.cost_bps / 1e4).alias("cost"), F.col("solved").isNotNull().alias("traded"))
    trades = stored(trades, "trades")
    daily = gross.join(trades.select("strategy", "date", "cost"), ["strategy", "date"], "left")
    daily = daily.select("date", "strategy", "gross", F.coalesce("cost", F.lit(0.0)).alias("cost"), (F.col("gross") - F.coalesce("cost", F.lit(0.0))).alias("return"))
    dated = targets.join(calendar.select("k", "date"), "k").select("date", "strategy", "ticker", "weight")
    warnings = trades.where("NOT traded").select("date", "strategy", F.lit("no solution; holdings were kept").alias("warning"))
    if messages is not None:
        warnings = messages.join(calendar.select("k", "date"), "k").select("date", "strategy", "warning").unionByName(warnings)
    return Result(daily, trades.drop("k"), dated, warnings, (rows, days, trades))


TARGETS = "k int, strategy string, ticker string, weight double, warning string"


def _walked(strategy: str, steps: Iterable[tuple[int, Known, np.ndarray]], assets: list[str], constraints: Constraints, rf: float) -> pd.DataFrame:
    """The targets of a strategy, each within reach of what is held before it; a step is its number, what is known, and the
    growth of each asset until the next. The opening trade is free."""
    held, out = None, []
    for k, known, growth_ in steps:
        limits = replace(constraints, max_turnover=None) if held is None else replace(constraints, previous=dict(zip(assets, held)))
        w, warnings = solve(strategy, known, assets, limits, rf)
        told = json.dumps(warnings) if warnings else None
        if w is not None:
            out.append(pd.DataFrame({"k": k, "strategy": strategy, "ticker": assets, "weight": w, "warning": told}))
        else:
            out.append(pd.DataFrame({"k": [k], "strategy": [strategy], "ticker": [None], "weight": [np.nan], "warning": [told]}))
        held = w if w is not None else held
        if held is None:
            break
        grown = held * growth_
        held = grown / grown.sum() if abs(grown.sum()) > 1e-12 else grown
    return pd.concat(out)


def _limited(rows: DataFrame, c: Config, last: int, strategies: list[str], constraints: Constraints, rf: float) -> list[DataFrame]:
    """Targets where turnover is limited: one group for each strategy, which holds the moments of each window and the
    growth of each asset from rebalance to rebalance. Only strategies of tails get the returns."""

    def on_returns(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot(index="idx", columns="ticker", values="return").sort_index()
        r = wide.to_numpy()
        steps = ((k, Known(returns=r[t - c.lookback : t]), np.prod(1 + r[t : t + c.every], axis=0)) for k, t in enumerate(range(c.lookback, len(r), c.every)))
        return _walked(part["strategy"].iloc[0], steps, list(wide.columns), constraints, rf)

    def on_moments(facts: pd.DataFrame, growths: pd.DataFrame) -> pd.DataFrame:
        growths = growths.pivot(index="k", columns="ticker", values="growth").sort_index()

        def steps() -> Iterator[tuple[int, Known, np.ndarray]]:
            for k, part in facts.groupby("k"):
                cov, _ = square(part, "cov")
                mu = part.groupby("i")["mean"].first().sort_index().to_numpy()
                yield int(k), Known(mu, cov, square(part, "gerber")[0].astype(float)), growths.loc[k].to_numpy()

        return _walked(facts["strategy"].iloc[0], steps(), list(growths.columns), constraints, rf)

    parts = []
    if whole := [s for s in strategies if s in BY_RETURNS]:
        some = rows.withColumn("strategy", F.explode(F.array(*map(F.lit, whole))))
        parts.append(some.groupBy("strategy").applyInPandas(on_returns, TARGETS))
    if rest := [s for s in strategies if s not in BY_RETURNS]:
        facts = window_moments(rows, c.lookback, c.every, last).withColumn("k", F.col("k").cast("int"))
        signs = comoves(estimation(rows, c, last), ("k",)) if BY_GERBER & set(rest) else None
        facts = facts.join(signs, ["k", "i", "j"]) if signs is not None else facts.withColumn("gerber", F.lit(None).cast("double"))
        grown = rows.where(F.col("idx") >= c.lookback).groupBy(F.floor((F.col("idx") - c.lookback) / F.lit(float(c.every))).cast("int").alias("k"), "ticker").agg(F.product(1 + F.col("return")).alias("growth"))
        of = lambda frame: frame.withColumn("strategy", F.explode(F.array(*map(F.lit, rest)))).groupBy("strategy")
        parts.append(of(facts).cogroup(of(grown)).applyInPandas(on_moments, TARGETS))
    return parts


@contextmanager
def counted(counter, of: int, tell: Callable[[int], None], every: float = 0.2) -> Iterator[None]:
    """While what is inside runs, tells what an accumulator has come to, up to ``of``; a task that runs again may count
    twice, so it never tells more. What has come in is told at the end too."""
    done, last = threading.Event(), 0

    def look() -> None:
        nonlocal last
        if (now := min(counter.value, of)) > last:
            last = now
            tell(now)

    def watch() -> None:
        while not done.wait(every):
            look()

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        look()


def backtest(returns: DataFrame, strategies: Iterable[str] = tuple(STRATEGIES), c: Config = Config(), constraints: Constraints = FREE, rf: float = 0.0, progress: Callable[[str, int, int], None] = lambda step, done, of: None, solved: Callable[[int, int], None] = lambda done, of: None) -> Result:
    """``Equal`` and ``InverseVariance`` are plain aggregates; the other names are those of ``optimize``. Raises ValueError
    with what the solvers told where none of the strategies has a solution at the first rebalance. ``progress`` is called
    after each step with its name, its number and the number of steps; ``solved`` while solvers run, from a thread of its
    own, with how many rebalances of strategies are solved, which never falls, and of how many."""
    rows = indexed(returns)
    facts = rows.agg(F.max("idx").alias("last"), F.count_distinct("ticker").alias("assets")).first()
    if (facts["assets"] or 0) < 2:
        raise ValueError("a backtest needs two assets at least")
    if facts["last"] < c.lookback:
        raise ValueError("there are no more dates than the lookback")
    progress("calendar", 1, 3)
    counter = returns.sparkSession.sparkContext.accumulator(0)
    windows = estimation(rows, c, facts["last"])
    names = list(strategies)
    plain = {"Equal": equal_weights, "InverseVariance": inverse_variance}
    parts = [plain[n](windows).withColumn("warning", F.lit(None).cast("string")) for n in names if n in plain]
    solver = [n for n in names if n not in plain]
    if solver and constraints.max_turnover is not None:
        parts += _limited(rows, c, facts["last"], solver, constraints, rf)
    elif solver:
        known = window_moments(rows, c.lookback, c.every, facts["last"])
        parts.append(optimize(windows.select("k", "date", "ticker", "return"), solver, constraints, rf, by="k", known=known, counter=counter))
    columns = (F.col("k").cast("int").alias("k"), "strategy", "ticker", "weight", "warning")
    found = parts[0].select(*columns)
    for p in parts[1:]:
        found = found.unionByName(p.select(*columns))
    of = len(solver) * ((facts["last"] - c.lookback) // c.every + 1)
    with counted(counter, of, lambda done: solved(done, of)):
        found = stored(found, "targets")
    targets = found.where("ticker IS NOT NULL").drop("warning")
    told = F.explode(F.from_json("warning", "array<string>")).alias("warning")
    messages = found.where("warning IS NOT NULL").select("k", "strategy", "warning").distinct().select("k", "strategy", told)
    if targets.where("k = 0").isEmpty():
        first = [r.warning for r in messages.where("k = 0").orderBy("strategy", "warning").collect()]  # a few for each strategy
        raise ValueError(f"no strategy has a solution at the first rebalance: {'; '.join(first)}")
    progress("targets", 2, 3)
    out = walk(rows, targets, c, messages)
    progress("walk", 3, 3)
    return replace(out, kept=(*out.kept, found))


def summary(result: Result, c: Config = Config(), rf: float = 0.0) -> DataFrame:
    """A row for each strategy: performance after costs, gross return, cost drag, turnover and cost."""
    net = performance(result.daily, "strategy", rf, c.periods)
    gross = result.daily.groupBy("strategy").agg((F.avg("gross") * c.periods).alias("gross_return"), F.count("*").alias("days"))
    traded = result.trades.groupBy("strategy").agg(F.avg("turnover").alias("average_turnover"), F.sum("cost").alias("total_cost"), F.count("*").alias("rebalances"))
    spacing = F.when(F.col("rebalances") < 2, 1.0).otherwise(F.greatest(F.lit(1.0), F.bround(F.col("days") / F.col("rebalances"))))
    return (
        net.join(gross, "strategy").join(traded, "strategy")
        .withColumns({"cost_drag": F.col("gross_return") - F.col("annual_return"), "annual_turnover": F.col("average_turnover") * c.periods / spacing})
        .drop("days")
    )


def curves(result: Result) -> DataFrame:
    """Growth of 1, before and after costs."""
    return result.daily.select("date", "strategy", growth("strategy", "gross").alias("gross_growth"), growth("strategy", "return").alias("growth"))

