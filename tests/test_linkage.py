"""Hierarchies from rows of a matrix, against the matrix in memory."""

import numpy as np
import pytest

from tidepanel.functions import solvers as so
from tidepanel.operators import linkage, optimize as op


def rows(spark, cov, names):
    n = len(names)
    return spark.createDataFrame([(names[i], names[j], float(cov[i, j])) for i in range(n) for j in range(n)], "i string, j string, cov double")


@pytest.mark.parametrize("n", [2, 3, 17, 100])
def test_weights_are_those_of_the_matrix(spark, n):
    rng = np.random.default_rng(n)
    r = rng.normal(size=(300, n)) * rng.uniform(0.5, 2, n) + rng.normal(size=(300, 1))
    r[:, -1] = r[:, 0] + 0.1 * r[:, -1]
    cov = np.cov(r.T)
    names = [f"A{i:03d}" for i in range(n)]
    got = linkage.hierarchical_weights(rows(spark, cov, names))
    assert np.abs(np.array([got[a] for a in names]) - so.hrp(cov)).max() < 1e-12
    deviation = np.sqrt(np.diag(cov))
    distance = np.sqrt((1 - np.clip(cov / np.outer(deviation, deviation), -1, 1)) / 2)
    pairs = spark.createDataFrame([(names[i], names[j], float(distance[i, j])) for i in range(n) for j in range(i + 1, n)], "i string, j string, d double")
    assert linkage.leaf_order(linkage.spanning_tree(pairs, names), names) == [names[i] for i in so.leaves(distance)]


def test_equal_distances_are_told_apart_by_the_pair(spark):
    names = list("abcdefgh")
    distance = np.ones((8, 8)) - np.eye(8)
    distance[2, 5] = distance[5, 2] = 0.5
    pairs = spark.createDataFrame([(names[i], names[j], float(distance[i, j])) for i in range(8) for j in range(i + 1, 8)], "i string, j string, d double")
    assert linkage.leaf_order(linkage.spanning_tree(pairs, names), names) == [names[i] for i in so.leaves(distance)]
    with pytest.raises(ValueError, match="without a distance"):
        linkage.spanning_tree(pairs, [*names, "z"])


def test_many_assets_in_rounds(spark):
    """Two thousand assets: pairs stay in Spark."""
    n = 2000
    frame = spark.range(n * n).selectExpr("format_string('A%04d', id div 2000) AS i", "format_string('A%04d', id % 2000) AS j", "CASE WHEN id div 2000 = id % 2000 THEN 1.0D + (id % 2000) % 7 ELSE 0.3D * cos((id div 2000) % 50 - (id % 2000) % 50) END AS cov")
    got = linkage.hierarchical_weights(frame)
    assert len(got) == n and abs(sum(got.values()) - 1) < 1e-9 and min(got.values()) > 0


def test_optimize_takes_the_tree_where_assets_are_many(spark, monkeypatch):
    rng = np.random.default_rng(1)
    r = rng.normal(size=(60, 6)) * 0.01
    days = np.datetime64("2020-01-01") + np.arange(60)
    frame = spark.createDataFrame([(str(days[t]), f"A{i}", float(r[t, i])) for t in range(60) for i in range(6)], "date string, ticker string, return double")
    few = {(x.strategy, x.ticker): x.weight for x in op.optimize(frame, ("HRP", "Gerber_HRP", "GMV")).collect()}
    monkeypatch.setattr(op, "MATRIX_ASSETS", 3)
    many = {(x.strategy, x.ticker): x.weight for x in op.optimize(frame, ("HRP", "Gerber_HRP", "GMV")).collect()}
    assert few.keys() == many.keys() and max(abs(few[k] - many[k]) for k in few) < 1e-12
