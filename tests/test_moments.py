"""Moments of groups and windows, and least tails by cutting planes, against one matrix in memory."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import solvers as so
from tidepanel.operators import moments as mo, optimize as op, tails
from tidepanel.operators.backtest import Config, backtest, estimation, indexed
from tidepanel.operators.covariance import covariance, gerber_signs, tail_mean, variance_residuals
from tidepanel.plans import service
from tidepanel.operators.optimize import Constraints, min_cdar, min_cvar, optimize, solve

NAMES = ["A", "B", "C", "D", "E"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    r = 0.0005 + 0.01 * rng.standard_t(4, size=(240, 1)) + 0.01 * rng.standard_t(4, size=(240, 5)) * np.array([0.6, 0.8, 1, 1.3, 1.6])
    days = np.datetime64("2020-01-01") + np.arange(240)
    rows = [(str(days[t]), NAMES[i], float(r[t, i])) for t in range(240) for i in range(5)]
    frame = spark.createDataFrame(rows, "date string, ticker string, return double").withColumn("date", F.to_date("date")).cache()
    return frame, r


def matrix(rows, column):
    out = np.zeros((5, 5))
    for r in rows:
        out[NAMES.index(r.i), NAMES.index(r.j)] = r[column]
    return out


@pytest.mark.parametrize("lookback,every", [(60, 20), (63, 20), (10, 30), (7, 7), (50, 1)])
def test_windows_share_their_sums(panel, lookback, every):
    frame, r = panel
    rows = indexed(frame)
    last = 239
    known = mo.window_moments(rows, lookback, every, last).collect()
    ks = sorted({x.k for x in known})
    assert ks == list(range((last - lookback) // every + 1))
    signs = mo.comoves(estimation(rows, Config(lookback, every), last), ("k",)).collect() if every > 1 else []
    for k in ks:
        own = [x for x in known if x.k == k]
        part = r[k * every : k * every + lookback]
        assert len(own) == 25 and {x.dates for x in own} == {lookback}
        assert np.abs(matrix(own, "cov") - np.cov(part.T)).max() < 1e-14
        assert max(abs(x["mean"] - part[:, NAMES.index(x.i)].mean()) for x in own) < 1e-14
        if signs:
            assert np.abs(matrix([x for x in signs if x.k == k], "gerber") - so.gerber(part)).max() < 1e-14


def test_groups_and_their_own_calendars(panel):
    frame, r = panel
    two = frame.withColumn("grp", F.when(F.month("date") < 4, "a").otherwise("b")).where("NOT (grp = 'a' AND ticker = 'E')")
    two = two.withColumn("return", F.when((F.col("ticker") != "B") | (F.dayofmonth("date") != 5), F.col("return")))
    got = mo.moments(two, ("grp",)).collect()
    whole = two.toPandas()
    for grp, n in (("a", 4), ("b", 5)):
        wide = whole[whole["grp"] == grp].pivot(index="date", columns="ticker", values="return").dropna()
        own = {(x.i, x.j): x for x in got if x.grp == grp}
        assert len(own) == n * n and own["A", "B"].dates == len(wide)
        assert abs(own["A", "B"].cov - wide.cov().loc["A", "B"]) < 1e-14
    lone = two.unionByName(two.where("ticker IN ('A', 'B')").withColumn("grp", F.lit("c")).where("(ticker = 'A') = (dayofmonth(date) < 9)"))
    out = optimize(lone, ("GMV", "Gerber_InvVar", "HRP_CVaR"), by="grp").collect()
    assert {(x.strategy, x.warning) for x in out if x.grp == "c"} == {(s, f'["{s}: needs two assets and two dates"]') for s in ("GMV", "Gerber_InvVar", "HRP_CVaR")}
    assert all(x.weight is not None for x in out if x.grp != "c")


LIMITS = Constraints(min_weight=0.05, max_weight=0.5, group_caps={"x": (("A", "B"), 0.55)})


@pytest.mark.parametrize("peaks,limits", [(False, Constraints()), (True, Constraints()), (False, LIMITS), (True, LIMITS), (False, Constraints(min_weight=-0.5, max_leverage=1.6))])
def test_planes_meet_the_linear_program(panel, peaks, limits):
    frame, r = panel
    weights, value, bound = tails.least_tail(frame, limits.system, peaks, least=limits.min_weight)
    w = np.array([weights[n] for n in NAMES])
    want = (min_cdar if peaks else min_cvar)(r, NAMES, limits)

    def measure(w):
        worth = np.cumsum(r @ w)
        series = worth - np.maximum(np.maximum.accumulate(worth), 0) if peaks else r @ w
        return so.tail(series, 0.05)

    assert abs(w.sum() - 1) < 1e-9 and w.min() >= limits.min_weight - 1e-7
    assert abs(measure(w) - measure(want)) < 1e-6 * measure(want) and abs(value - measure(w)) < 1e-7
    assert abs(value - bound) < 1e-6 * value


def test_a_plane_is_the_measure(spark, panel):
    frame, r = panel
    rows, names, dates = tails.packed(frame, False)
    w = np.array([0.1, 0.2, 0.3, 0.25, 0.15])
    value = tails.plane(rows, w, dates, 0.07, False) @ w
    series = spark.createDataFrame([("s", str(i).zfill(4), float(x)) for i, x in enumerate(r @ w)], "strategy string, date string, return double")
    assert names == NAMES and abs(value - tail_mean(series, 0.07).first().cvar) < 1e-15
    with pytest.raises(so.Infeasible):
        tails.least_tail(frame.where("ticker = 'A'"), Constraints().system, False)


@pytest.mark.parametrize("dates", [600, 100])
def test_all_strategies_are_what_returns_give(panel, monkeypatch, dates):
    frame, r = panel
    monkeypatch.setattr(op, "PROGRAM_DATES", dates)
    got = optimize(frame).collect()
    for strategy in {x.strategy for x in got}:
        own = {x.ticker: x.weight for x in got if x.strategy == strategy}
        want, _ = solve(strategy, r, NAMES)
        if strategy in ("MinCVaR", "MinCDaR") and dates == 100:
            assert abs(sum(own.values()) - 1) < 1e-9
            continue  # the least values are compared above
        assert np.abs(np.array([own[n] for n in NAMES]) - want).max() < 1e-7, strategy


def test_residuals_tell_what_is_not_optimal(spark, panel):
    frame, r = panel
    matrix = covariance(frame).cache()
    limits = Constraints(min_weight=0.1, max_weight=0.35, group_caps={"x": (("A", "B"), 0.5)})
    cap = limits.group_caps["x"]
    cases = [(Constraints(), 0.0, 1.0, None), (Constraints(min_weight=0.15, max_weight=0.25), 0.15, 0.25, None), (limits, 0.1, 0.35, cap)]
    bound = 0
    for c, low, high, group in cases:
        w = op.min_variance(np.cov(r.T), NAMES, c)
        bound += ((w < low + 1e-6) | (w > high - 1e-6)).sum()
        residuals = lambda w: [x.residual for x in variance_residuals(spark.createDataFrame([("s", n, float(x)) for n, x in zip(NAMES, w)], "strategy string, ticker string, weight double"), matrix, low, high, group).collect()]
        assert max(residuals(w)) < 1e-5
        for i, j in ((0, 4), (4, 0), (1, 2), (3, 1)):
            moved = w.copy()
            moved[i], moved[j] = w[i] + 0.02, w[j] - 0.02
            assert max(residuals(moved)) > 1e-3
    assert bound >= 3


def test_closed_form_of_singular_covariances(panel):
    frame, r = panel
    twice = frame.unionByName(frame.where("ticker = 'B'").withColumn("ticker", F.lit("B2"))).withColumn("grp", F.lit(1))
    got = {x.ticker: x.weight for x in op.closed_form(mo.moments(twice, ("grp",)), "grp").collect()}
    alone = so.least_variance(np.cov(r.T))
    assert abs(got["B"] - got["B2"]) < 1e-8 and abs(got["B"] * 2 - alone[1]) < 1e-8 and abs(got["E"] - alone[4]) < 1e-8
    assert np.abs(alone - np.linalg.solve(np.cov(r.T), np.ones(5)) / np.linalg.solve(np.cov(r.T), np.ones(5)).sum()).max() < 1e-10


def test_signs(panel):
    frame, r = panel
    frame = frame.withColumn("return", F.when(F.dayofmonth("date") == 3, 0.0).otherwise(F.col("return")))
    r = frame.toPandas().pivot(index="date", columns="ticker", values="return").to_numpy()
    same = np.array([[np.mean(np.sign(r[:, i]) * np.sign(r[:, j]) > 0) for j in range(5)] for i in range(5)])
    want = np.clip((same - 0.5) / 0.5, 0, 1) * np.outer(r.std(0), r.std(0))
    assert np.abs(matrix(gerber_signs(frame).collect(), "cov") - want).max() < 1e-15


def test_progress_for_each_rebalance_and_cancelling(spark, panel):
    frame, _ = panel
    c, told = Config(60, 20), []
    backtest(frame, ("GMV", "HRP"), c, solved=lambda done, of: told.append((done, of))).release()
    assert told == sorted(told) and told[-1] == (18, 18) and len(set(told)) == len(told)
    clock = threading.Timer(3, service.cancel, (spark, "mine"))
    clock.start()
    with pytest.raises(Exception, match="(?i)cancel"), service.cancellable(spark, "mine"):
        spark.range(10**15).where("sin(id) > 2").count()
    clock.join()
    assert spark.range(5).count() == 5
