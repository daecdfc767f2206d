"""Boosted trees that grow by leaves, against a plain booster that follows the cuts one by one."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.features import names
from tidepanel.operators import boosting, forecast as fc, splits as sp
from tidepanel.operators.boosting import Settings
from tidepanel.sources.synthetic import synthetic_prices

SMALL = Settings(trees=12, step=0.3, leaves=9, least_child=10, stop_after=3, bins=31)


def plain(bins, target, key, stops, settings):
    """Scores of all rows, by the trees up to the least loss: one leaf is cut at a time, and sums are made afresh."""
    base = target[~stops].mean()
    score = np.full(len(target), base)
    history, best, least = [score], 0, np.inf
    shrink = lambda g: np.sign(g) * max(abs(g) - settings.l1, 0)
    part = lambda g: shrink(g.sum()) ** 2 / (len(g) + settings.l2)
    for number in range(settings.trees):
        features = boosting.features_of(number, bins.shape[1], settings)
        used = ~stops & boosting.drawn(key, number, settings)
        gradient = score - target
        leaves, depths = [np.ones(len(target), bool)], [0]
        while len(leaves) < settings.leaves:
            cuts = []
            for n, leaf in enumerate(leaves):
                if depths[n] == settings.depth:
                    continue
                for f in features:
                    for b in range(settings.bins):
                        left, right = leaf & (bins[:, f] <= b), leaf & (bins[:, f] > b)
                        if (left & used).sum() >= settings.least_child and (right & used).sum() >= settings.least_child:
                            cuts.append((part(gradient[left & used]) + part(gradient[right & used]) - part(gradient[leaf & used]), n, left, right))
            top = max((c[0] for c in cuts), default=0)
            if top <= 1e-12:
                break
            _, n, left, right = next(c for c in cuts if c[0] >= top * (1 - 1e-10))
            leaves[n : n + 1] = [left, right]
            depths[n : n + 1] = [depths[n] + 1] * 2
        if len(leaves) == 1:
            break
        score = score.copy()
        for leaf in leaves:
            g = gradient[leaf & used]
            score[leaf] -= settings.step * shrink(g.sum()) / (len(g) + settings.l2)
        history.append(score)
        loss = ((score - target)[stops] ** 2).mean() if stops.any() else 0
        if stops.any() and loss < least * (1 - 1e-10):
            least, best = loss, number + 1
        elif stops.any() and number + 1 - best >= settings.stop_after:
            break
    return history[best if stops.any() else -1]


def data(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = np.round(x[:, 3])
    y = np.where(x[:, 0] > 0.3, 1.0, -1.0) * x[:, 1] + 0.3 * x[:, 3] + 0.1 * rng.normal(size=n)
    return x, y, rng.integers(-(2**62), 2**62, n), np.arange(n) >= n * 0.85


@pytest.mark.parametrize("settings", [SMALL, Settings(trees=3, step=0.5, leaves=6, least_child=5, bagging=1, columns=1, l1=0, l2=0, bins=15), Settings(trees=2, step=0.5, leaves=8, depth=2, least_child=5, bins=15)])
def test_growth_in_lots_is_growth_by_single_cuts(settings):
    x, y, key, stops = data(400)
    model = boosting.fit_arrays(x, y, key, stops, settings)
    want = plain(boosting.binned(x, model.edges), y, key, stops, settings)
    assert np.abs(model.scores(x) - want).max() < 1e-9
    assert abs(model.importances().sum() - 1) < 1e-12
    if settings.depth > 0:
        assert max(max(t.depth) for t in model.trees) <= settings.depth


def test_trees_of_tables_are_those_of_arrays(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    x, y, _, stops = data(500, 3)
    rows = [(i, *map(float, x[i]), float(y[i]), bool(stops[i])) for i in range(len(y))]
    frame = spark.createDataFrame(rows, "i long, a double, b double, c double, d double, y double, stops boolean").repartition(4)
    columns = list("abcd")
    told = []
    model = boosting.fit(frame, columns, SMALL, target="y", stops="stops", key=("i",), progress=told.append)
    key = np.array([r.k for r in frame.orderBy("i").select(F.xxhash64("i").alias("k")).collect()])
    alone = boosting.fit_arrays(x, y, key, stops, SMALL)
    assert len(model.trees) == len(alone.trees) and [t.feature for t in model.trees] == [t.feature for t in alone.trees] and [t.cut for t in model.trees] == [t.cut for t in alone.trees]
    got = boosting.predict(frame, columns, model).orderBy("i").collect()
    assert np.abs(np.array([r.raw for r in got]) - alone.scores(x)).max() < 1e-9
    assert np.abs(np.array([r.raw for r in got]) - plain(boosting.binned(x, alone.edges), y, key, stops, SMALL)).max() < 1e-9
    assert told == sorted(told) and told[-1] == 1.0
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit(frame.where("false"), columns, SMALL, target="y", stops="stops", key=("i",))


def test_a_thousand_models_in_one_job(spark):
    n, rng = 90, np.random.default_rng(4)
    tickers = [f"T{i:04d}" for i in range(1000)]
    x = rng.normal(size=(1000, n))
    days = [date(2020, 1, 1) + timedelta(d) for d in range(n)]
    frame = spark.createDataFrame([(t, days[d], float(x[i, d]), float(2.0 * (x[i, d] > 0)), d < 70, 60 <= d < 70) for i, t in enumerate(tickers) for d in range(n)], "ticker string, date date, a double, target_scaled double, is_train boolean, is_validation boolean")
    frame = frame.withColumn("is_train", F.col("is_train") & (F.col("ticker") != "T0007"))
    told = boosting.fit_each(frame, ["a"], Settings(trees=5, step=0.5, leaves=3, least_child=5)).collect()
    failed = [r for r in told if r.error is not None]
    assert [r.ticker for r in failed] == ["T0007"] and failed[0].raw is None
    fine = [r for r in told if r.error is None]
    assert len({r.ticker for r in fine}) == 999 and len(fine) == 999 * 20
    truth = {(t, days[d]): 2.0 * (x[i, d] > 0) for i, t in enumerate(tickers) for d in range(n)}
    assert np.mean([abs(r.raw - truth[r.ticker, r.date]) < 0.5 for r in fine]) > 0.9


@pytest.fixture(scope="module")
def prices(spark):
    return synthetic_prices(spark, ["AAA", "BBB"], date(2018, 1, 1), date(2019, 7, 1)).cache()


def test_one_ticker_alone_or_pooled(prices):
    one = prices.where("ticker = 'AAA'")
    settings = Settings(trees=4, leaves=5)
    frames = [fc.boosted(one, fc.Params(pooled=pooled, trees=settings))[0].orderBy("date").collect() for pooled in (True, False)]
    assert len(frames[0]) > 20 and [r.date for r in frames[0]] == [r.date for r in frames[1]]
    assert max(abs(a.predicted / b.predicted - 1) for a, b in zip(*frames)) < 1e-9


def test_tickers_that_cannot_be_fitted_are_rows(prices):
    def refuses(values, target, key, stops, settings):
        if len(values) % 2 == 0 and refuses.all:
            raise ArithmeticError("it can't be fitted")
        return boosting.fit_arrays(values, target, key, stops, settings)

    refuses.all = True
    rows = sp.validation(sp.splits(prices, 0.7)[0], 0.15)
    rows = rows.withColumn("is_train", F.col("is_train") & ((F.col("ticker") == "AAA") | (F.col("seq_no") < 60)))
    rows = rows.withColumn("is_train", F.col("is_train") & ((F.col("ticker") == "BBB") | (F.col("seq_no") < 61)))
    told = boosting.fit_each(rows, fc.columns_of(10), Settings(trees=2), date="target_date", fit=refuses)
    got = {(r.ticker, r.error) for r in told.select("ticker", "error").distinct().collect()}
    assert got == {("AAA", None), ("BBB", "ArithmeticError: it can't be fitted")}
    forecast, failed = fc.forecast(prices, "gbt", fc.Params(pooled=False, trees=Settings(trees=2)))
    assert forecast.columns == ["ticker", "date", "predicted", "actual"] and failed.count() == 0
    assert {r.ticker for r in forecast.select("ticker").distinct().collect()} == {"AAA", "BBB"}


def test_importances_are_shares_of_the_cuts(prices):
    rows = sp.validation(sp.splits(prices, 0.7)[0], 0.15)
    shares = fc.importances(rows, fc.Params(trees=Settings(trees=2, leaves=4)))
    assert set(shares) == set(names()) and abs(sum(shares.values()) - 1) < 1e-9 and min(shares.values()) >= 0
