"""Solvers by their mathematical properties; optimizers and backtests by invariants and against a plain loop."""

import json
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import solvers as so
from tidepanel.operators import backtest as bt, covariance as cv, optimize as op
from tidepanel.plans import service

NAMES = ["A", "B", "C", "D"]


def panel(n=160, k=4, seed=1):
    rng = np.random.default_rng(seed)
    common = rng.normal(0, 0.01, (n, 1))
    return rng.normal(0.0005, 0.01, (n, k)) * np.linspace(0.5, 1.5, k) + common


@pytest.fixture(scope="module")
def returns(spark):
    rows = [(date(2020, 1, 1) + timedelta(days=i), t, float(x)) for i, r in enumerate(panel()) for t, x in zip(NAMES, r)]
    return spark.createDataFrame(rows, "date date, ticker string, return double").cache()


def cov_of(n, seed=0):
    x = np.random.default_rng(seed).normal(size=(n * 4, n))
    return np.cov(x.T)


@pytest.mark.parametrize("n", [2, 3, 8, 18])
def test_risk_parity_gives_equal_shares(n):
    cov = cov_of(n, n)
    assert np.abs(so.risk_shares(so.risk_parity(cov), cov) - 1 / n).max() < 1e-8
    flat = np.diag(np.arange(1.0, n + 1))
    inverse = 1 / np.sqrt(np.diag(flat))
    assert np.allclose(so.risk_parity(flat), inverse / inverse.sum(), atol=1e-8)


def test_min_variance_is_the_closed_form_where_bounds_are_slack():
    cov = cov_of(6)
    free = np.linalg.solve(cov, np.ones(6))
    assert np.allclose(op.min_variance(cov, list("abcdef"), op.Constraints(-5, 5)), free / free.sum(), atol=1e-6)


def test_constraints_hold():
    cov, names = cov_of(6, 3), list("abcdef")
    c = op.Constraints(-0.2, 0.35, max_leverage=1.3, group_caps={"x": (("a", "b"), 0.2)}, group_floors={"y": (("c",), 0.1)}, max_turnover=0.9, previous=dict.fromkeys(names, 1 / 6))
    for w in (op.min_variance(cov, names, c), op.max_return(np.arange(6) / 1000, names, c)):
        assert abs(w.sum() - 1) < 1e-9 and w.min() > -0.2 - 1e-6 and w.max() < 0.35 + 1e-6 and np.abs(w).sum() < 1.3 + 1e-6
        assert w[0] + w[1] < 0.2 + 1e-6 and w[2] > 0.1 - 1e-6 and np.abs(w - 1 / 6).sum() < 0.9 + 1e-6
    with pytest.raises(so.Infeasible):
        op.min_variance(cov, names, op.Constraints(0, 0.1))
    with pytest.raises(so.Infeasible):
        op.min_variance(cov, names, op.Constraints(group_caps={"x": (tuple("abc"), 0.2), "z": (tuple("def"), 0.2)}))
    assert op.Constraints(group_caps={"x": (("zz",), 1)}).conflicts(names)


def test_efficient_set_rises_and_max_sharpe_is_its_best():
    r = panel()
    mu, cov = r.mean(0), np.cov(r.T)
    points = op.efficient_points(mu, cov, NAMES, points=15)
    assert len(points) == 15
    assert all(b["annual_volatility"] >= a["annual_volatility"] - 1e-7 and b["annual_return"] >= a["annual_return"] - 1e-9 for a, b in zip(points, points[1:]))
    w = op.max_sharpe(mu, cov, NAMES)
    tangency = np.linalg.solve(cov, mu)
    if (tangency > 0).all():
        best = mu @ tangency / np.sqrt(tangency @ cov @ tangency)
        assert mu @ w / np.sqrt(w @ cov @ w) > 0.99 * best


@pytest.mark.parametrize("solve, risk", [(op.min_cvar, lambda r, w: so.tail(r @ w)), (op.min_cdar, lambda r, w: so.tail(np.cumsum(r @ w) - np.maximum.accumulate(np.maximum(np.cumsum(r @ w), 0))))])
def test_tail_programs_are_optimal(solve, risk):
    r = panel(100)
    w = solve(r, NAMES)
    assert abs(w.sum() - 1) < 1e-9 and w.min() >= -1e-9
    rng = np.random.default_rng(5)
    others = [np.eye(4)[i] for i in range(4)] + list(rng.dirichlet(np.ones(4), 300)) + [np.abs(w + rng.normal(0, 0.02, 4)) for _ in range(100)]
    assert all(risk(r, w) <= risk(r, v / v.sum()) + 1e-7 for v in others)


def test_hierarchical_and_gerber():
    r = panel()
    for w in (so.hrp(np.cov(r.T)), so.hrp_cvar(r)):
        assert abs(w.sum() - 1) < 1e-12 and (w > 0).all()
    two = np.diag([1.0, 4.0])
    assert np.allclose(so.hrp(two), [0.8, 0.2])
    assert np.linalg.eigvalsh(so.gerber(r))[0] > -1e-12
    assert so.leaves(np.array([[0, 5, 1], [5, 0, 4], [1, 4, 0.0]])) == [0, 2, 1]


@pytest.mark.parametrize("slice_, stretch", [(256, 1024), (3, 100), (1, 7)])
def test_gerber_and_covariance_by_block(returns, monkeypatch, slice_, stretch):
    monkeypatch.setattr(cv, "SLICE", slice_)
    monkeypatch.setattr(cv, "STRETCH", stretch)
    r = panel()
    for frame, want in ((cv.gerber(returns), so.gerber(r)), (cv.covariance(returns), np.cov(r.T))):
        got = frame.toPandas().pivot(index="i", columns="j", values="cov")
        assert np.allclose(got, want)
    w = np.array([0.1, 0.2, 0.3, 0.4])
    weights = returns.sparkSession.createDataFrame([("s", t, float(x)) for t, x in zip(NAMES, w)], "strategy string, ticker string, weight double")
    got = cv.risk_contributions(weights, cv.covariance(returns)).orderBy("ticker").toPandas()["share"]
    assert np.allclose(got, so.risk_shares(w, np.cov(r.T)))
    series = returns.where("ticker = 'A'").withColumnRenamed("ticker", "strategy")
    assert np.isclose(cv.tail_mean(series).first().cvar, so.tail(r[:, 0]))


def test_all_strategies(returns):
    got = op.optimize(returns).toPandas()
    assert set(got["strategy"]) == set(op.STRATEGIES) and np.allclose(got.groupby("strategy")["weight"].sum(), 1)
    limited = op.optimize(returns, ("HRP", "Markowitz_MinVar"), op.Constraints(0, 0.1)).toPandas().set_index("strategy")
    assert "constraints" in json.loads(limited.loc["HRP", "warning"].iloc[0])[0]
    assert pd.isna(limited.loc["Markowitz_MinVar", "ticker"]) and "largest" in limited.loc["Markowitz_MinVar", "warning"]
    with pytest.raises(ValueError):
        op.optimize(returns, ("Nothing",))
    with pytest.raises(service.PriceLevels):
        service.optimized(returns.withColumn("return", F.lit(50.0)))
    points, best = service.efficient(returns, points=8)
    assert points.count() == 8 and best.count() == 1


def slow_backtest(r, weights, c):
    """Day by day: drift, trade, pay."""
    held, out = np.zeros(r.shape[1]), []
    for t in range(c.lookback, len(r)):
        cost = 0.0
        if (t - c.lookback) % c.every == 0:
            target = weights(r[t - c.lookback : t])
            if target is not None:
                cost = np.abs(target - held).sum() * c.cost_bps / 1e4
                held = target
        gross = held @ r[t]
        out.append((gross, gross - cost))
        held = held * (1 + r[t]) / (1 + gross)
    return np.array(out)


@pytest.mark.parametrize("name, weights", [("Equal", lambda x: np.full(4, 0.25)), ("InverseVariance", lambda x: (1 / x.var(0, ddof=1)) / (1 / x.var(0, ddof=1)).sum()), ("Markowitz_MinVar", lambda x: op.min_variance(np.cov(x.T), NAMES))])
def test_backtest_equals_the_loop(returns, name, weights):
    c = bt.Config(lookback=60, every=15, cost_bps=25)
    result = bt.backtest(returns, (name,), c)
    got = result.daily.orderBy("date").toPandas()
    want = slow_backtest(panel(), weights, c)
    assert np.allclose(got["gross"], want[:, 0], atol=1e-7) and np.allclose(got["return"], want[:, 1], atol=1e-7)
    s = bt.summary(result, c).first()
    assert s.rebalances == 7 and s.total_cost > 0 and s.cost_drag > 0 and result.warnings.count() == 0
    result.release()


def test_a_failed_rebalance_holds_on(spark, returns):
    c = bt.Config(lookback=60, every=15)
    rows = bt.indexed(returns)
    targets = bt.equal_weights(bt.estimation(rows, c, 159)).where("k <> 2")
    late = targets.withColumn("strategy", F.lit("Late")).where("k > 0")  # none at the first: left out
    result = bt.walk(rows, targets.unionByName(late), c)
    calls = iter(range(99))
    want = slow_backtest(panel(), lambda x: None if next(calls) == 2 else np.full(4, 0.25), c)
    got = result.daily.orderBy("date").toPandas()
    assert set(got["strategy"]) == {"Equal"} and np.allclose(got["return"], want[:, 1], atol=1e-9)
    assert result.warnings.count() == 1 and result.trades.where("NOT traded").first().turnover == 0


def test_solver_messages_and_a_first_rebalance_without_solution(returns, monkeypatch):
    c, seen = bt.Config(lookback=60, every=15), []
    result = bt.backtest(returns, ("HRP",), c, op.Constraints(0, 0.5), progress=lambda *step: seen.append(step))
    told = result.warnings.collect()
    assert len(told) == 7 and all("constraints" in r.warning for r in told) and seen == [("calendar", 1, 3), ("targets", 2, 3), ("walk", 3, 3)]
    with pytest.raises(ValueError, match="largest weights don't add up"):
        bt.backtest(returns, ("Markowitz_MinVar",), c, op.Constraints(0, 0.1))
    with pytest.raises(ValueError, match="largest weights don't add up"):
        bt.backtest(returns, ("Markowitz_MinVar",), c, op.Constraints(0, 0.1, max_turnover=0.1))
    both = bt.backtest(returns, ("Equal", "Markowitz_MinVar"), c, op.Constraints(0, 0.1))
    assert {r.strategy for r in both.daily.select("strategy").distinct().collect()} == {"Equal"} and both.warnings.where("strategy = 'Markowitz_MinVar'").count() == 7


def test_ranges_of_requests(returns):
    for c in (op.Constraints(-1.5, 1), op.Constraints(max_weight=0.0), op.Constraints(max_leverage=6.0), op.Constraints(max_turnover=5.0, previous={"A": 1.0})):
        with pytest.raises(ValueError, match="not within"):
            service.optimized(returns, ("Markowitz_MinVar",), c)


def test_frame_views(spark):
    from tidepanel.sources import frames

    long = spark.createDataFrame([(date(2020, 1, d), t, x) for d, t, x in ((1, "A", 1.0), (2, "A", 2.0), (3, "A", None), (1, "B", 5.0))], "date date, ticker string, price double")
    assert {(r.ticker, r.date.day, r.price) for r in frames.latest(long).collect()} == {("A", 2, 2.0), ("B", 1, 5.0)}
    assert [(r.date.day, r.value) for r in frames.points(frames.to_wide(long), "A").collect()] == [(1, 1.0), (2, 2.0)]
    weights = spark.createDataFrame([("s", "A", 0.2), ("s", "B", 0.8), ("s", "C", 0.0), ("x", "A", 1.0)], "strategy string, ticker string, weight double")
    assert [r.ticker for r in frames.ranked_weights(weights, "s").collect()] == ["B", "A"]


def test_turnover_limit(returns):
    c = bt.Config(lookback=60, every=15)
    result = bt.backtest(returns, ("Markowitz_MinVar",), c, op.Constraints(max_turnover=0.05))
    moves = [r.turnover for r in result.trades.orderBy("date").collect()]
    assert abs(moves[0] - 1) < 1e-6 and max(moves[1:]) < 0.05 + 1e-6
    with pytest.raises(ValueError):
        bt.backtest(returns, ("Equal",), bt.Config(lookback=500))
    with pytest.raises(ValueError):
        bt.backtest(returns.where("ticker = 'A'"), ("Equal",), c)


def test_pipeline(spark, tmp_path):
    from tidepanel.sources.synthetic import synthetic_prices

    prices = synthetic_prices(spark, ["AAA", "BBB", "CCC"], date(2018, 1, 1), date(2019, 7, 1))
    out = service.pipeline(prices, strategies=("HRP", "RiskParity", "Markowitz_MinVar"))
    assert out.performance.count() == 3 and out.chosen.count() == 1 and out.metrics.count() == 3 and out.failures.count() == 0
    assert abs(out.chosen_weights.agg(F.sum("weight")).first()[0] - 1) < 1e-9
    run = service.track(spark, str(tmp_path), "pipeline", {"backend": "naive"}, {"mase (mean)": 1.0}, tables={"weights": out.chosen_weights})
    assert service.runs(spark, str(tmp_path)).first().run_id == run
    service.save_json(out.chosen_weights, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
