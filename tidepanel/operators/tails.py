"""Least mean of the worst losses, or of the deepest falls from a peak, over a history of any length, by cutting planes.

Both are the largest of linear functions of the weights, one for each choice of worst dates. For given weights Spark finds
the worst dates and adds up their returns by asset: one plane that the measure never falls below, and touches at these
weights. The planes so far bound the measure from below; the next weights are the nearest to the best so far at which
all planes are below a level between that bound and the best value. It ends when the two meet. A step is one Spark job
over a row for each date; what comes to the driver is one number for each asset, and the master problem has as many rows as
there were steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.solvers import Infeasible, cleaned, quadratic
from ..shared import drop, stored
from ..sources.frames import aligned

#: Between the bound and the best value.
LEVEL = 0.3


def packed(returns: DataFrame, peaks: bool) -> tuple[DataFrame, list[str], int]:
    """A stored row ``idx, x`` for each date of the shared calendar: the returns of all assets in the order of their names,
    or with ``peaks`` their sums so far; the names; and the number of dates."""
    whole = aligned(returns, "return").select("date", "ticker", "return").distinct()
    dates = whole.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)
    value = F.sum("return").over(Window.partitionBy("ticker").orderBy("date")) if peaks else F.col("return")
    rows = whole.withColumn("v", value).groupBy("date").agg(F.sort_array(F.collect_list(F.struct("ticker", "v"))).alias("x"))
    rows = stored(rows.join(dates, "date").select("idx", F.col("x.v").alias("x")), "dates")
    names = [r.ticker for r in whole.select("ticker").distinct().orderBy("ticker").collect()]  # as many as there are weights
    return rows, names, rows.count()


def plane(rows: DataFrame, weights: np.ndarray, dates: int, alpha: float, peaks: bool) -> np.ndarray:
    """The slopes of the plane that touches the measure at ``weights``."""
    k = alpha * dates
    whole = int(np.floor(k + 1e-12))
    w = F.array(*map(F.lit, weights.tolist()))
    worth = rows.select("idx", F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("worth"))
    if peaks:
        top = F.max(F.struct("worth", (-F.col("idx")).alias("at"))).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
        worth = worth.withColumn("top", top)
        above = F.col("top.worth") > 0  # the first peak is nought
        loss, peak = F.greatest(F.col("top.worth"), F.lit(0.0)) - F.col("worth"), F.when(above, -F.col("top.at"))
    else:
        loss, peak = -F.col("worth"), F.lit(None).cast("int")
    worst = worth.select("idx", loss.alias("loss"), peak.alias("peak")).orderBy(F.desc("loss"), "idx").limit(whole + (k - whole > 1e-12))
    place = F.row_number().over(Window.orderBy(F.desc("loss"), "idx"))
    share = F.when(place <= whole, 1.0).otherwise(k - whole) / k
    shares = worst.select("idx", "peak", share.alias("share"))
    signed = shares.select("idx", (-F.col("share")).alias("share")).unionByName(shares.where("peak IS NOT NULL").select(F.col("peak").alias("idx"), "share"))
    signed = signed.groupBy("idx").agg(F.sum("share").alias("share"))
    slopes = rows.join(signed, "idx").select("share", F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("share") * F.col("v")).alias("slope"))
    out = np.zeros(len(weights))
    for r in slopes.collect():
        out[r["at"]] = r.slope
    return out


def least_tail(returns: DataFrame, system: Callable[[list[str]], tuple], peaks: bool, alpha: float = 0.05, tolerance: float = 1e-8, steps: int = 300, least: float = 0.0) -> tuple[dict[str, float], float, float]:
    """Weights, the measure at them, and the bound that no weights can be below. ``system`` gives the constraints of
    assets, as ``Constraints.system`` does; ``tolerance`` is relative to the size of the first plane."""
    rows, names, dates = packed(returns, peaks)
    if len(names) < 2 or dates < 2:
        raise Infeasible("needs two assets and two dates")
    A, b, G, h = system(names)
    n, width = len(names), A.shape[1]
    wide = lambda m: np.hstack([m, np.zeros((len(m), width + 1 - m.shape[1]))])
    near = np.zeros((width, width))
    near[:n, :n] = np.eye(n)
    w = quadratic(near, np.concatenate([np.full(n, -1 / n), np.zeros(width - n)]), A, b, G, h)[:n]
    planes: list[np.ndarray] = []
    best, best_w, bound, size = np.inf, w, -np.inf, 1.0
    for _ in range(steps):
        slope = plane(rows, w, dates, alpha, peaks)
        size = size if planes else max(np.abs(slope).max(), 1e-12)
        planes.append(slope / size)
        if (value := float(planes[-1] @ w)) < best:
            best, best_w = value, w
        cuts = np.array(planes)
        # The bound: the least height above all planes.
        over = np.hstack([cuts, np.zeros((len(cuts), width - n)), -np.ones((len(cuts), 1))])
        at = quadratic(1e-12 * np.eye(width + 1), np.append(np.zeros(width), 1.0), wide(A), b, np.vstack([wide(G), over]), np.append(h, np.zeros(len(cuts))))
        bound = max(bound, float((cuts @ at[:n]).max()))
        if best - bound <= tolerance:
            break
        level = bound + LEVEL * (best - bound)
        try:
            w = quadratic(near, np.concatenate([-best_w, np.zeros(width - n)]), A, b, np.vstack([G, over[:, :width]]), np.append(h, np.full(len(cuts), level)))[:n]
        except Infeasible:
            w = at[:n]
    drop(rows)
    if best - bound > max(tolerance, 1e-6):
        raise Infeasible("no least tail was found")
    w = cleaned(best_w, least)
    return dict(zip(names, w.tolist())), float(best * size), float(bound * size)
