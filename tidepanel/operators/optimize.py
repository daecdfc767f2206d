"""Portfolio strategies under linear constraints, solved for each group of returns in Spark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.solvers import Infeasible, cleaned, gerber, hierarchical, hrp, hrp_cvar, least_variance, positive_definite, quadratic, risk_parity, risk_shares
from ..shared import stored
from ..sources.frames import aligned
from .performance import PERIODS


@dataclass(frozen=True)
class Constraints:
    min_weight: float = 0.0
    max_weight: float = 1.0
    max_leverage: float | None = None
    group_caps: dict[str, tuple[tuple[str, ...], float]] = field(default_factory=dict)
    group_floors: dict[str, tuple[tuple[str, ...], float]] = field(default_factory=dict)
    max_turnover: float | None = None
    previous: dict[str, float] = field(default_factory=dict)

    def conflicts(self, assets: list[str]) -> list[str]:
        """What makes the constraints impossible for these assets, told before any solving."""
        n, out = len(assets), []
        if self.min_weight > self.max_weight:
            out.append("the least weight is above the largest")
        if n * self.max_weight < 1 - 1e-12:
            out.append("the largest weights don't add up to 1")
        if n * self.min_weight > 1 + 1e-12:
            out.append("the least weights add up to more than 1")
        if self.max_leverage is not None and self.max_leverage < 1:
            out.append("weights that sum to 1 have a leverage of 1 at least")
        for kind, groups in (("cap", self.group_caps), ("floor", self.group_floors)):
            for name, (members, limit) in groups.items():
                if unknown := sorted(set(members) - set(assets)):
                    out.append(f"{kind} {name} names unknown assets: {', '.join(unknown)}")
                elif kind == "cap" and len(set(members)) * self.min_weight > limit + 1e-12:
                    out.append(f"cap {name} is below its members' least weights")
                elif kind == "floor" and len(set(members)) * self.max_weight < limit - 1e-12:
                    out.append(f"floor {name} is above its members' largest weights")
        for name in self.group_caps.keys() & self.group_floors.keys():
            if self.group_floors[name][1] > self.group_caps[name][1]:
                out.append(f"floor {name} is above its cap")
        if self.max_turnover is not None and self.max_turnover < 0:
            out.append("turnover is negative")
        return out

    def out_of_range(self) -> list[str]:
        """What lies outside the ranges that a request may ask for."""
        out = []
        for name, value, low, high in (("min_weight", self.min_weight, -1.0, 1.0), ("max_weight", self.max_weight, 0.0, 1.0), ("max_leverage", self.max_leverage, 1.0, 5.0), ("max_turnover", self.max_turnover, 0.0, 4.0)):
            if value is not None and not (low <= value <= high) or name == "max_weight" and value == 0:
                out.append(f"{name} is not within {low:g} to {high:g}")
        return out

    def extra(self) -> bool:
        return bool(self.max_leverage is not None or self.group_caps or self.group_floors or self.max_turnover is not None)

    def system(self, assets: list[str]):
        """Equalities and inequalities over the weights and, where absolute values are bounded, their helpers."""
        n = len(assets)
        I = np.eye(n)  # noqa: E741
        rows, right, helpers = [I, -I], [np.full(n, self.max_weight), np.full(n, -self.min_weight)], []
        for groups, sign in ((self.group_caps, 1.0), (self.group_floors, -1.0)):
            for members, limit in groups.values():
                rows.append(sign * np.array([[1.0 if a in members else 0.0 for a in assets]]))
                right.append(np.array([sign * limit]))
        if self.max_leverage is not None:
            helpers.append((np.zeros(n), self.max_leverage))
        if self.max_turnover is not None and self.previous:
            helpers.append((np.array([self.previous.get(a, 0.0) for a in assets]), self.max_turnover))
        width = n * (1 + len(helpers))
        G, h = [np.hstack([r, np.zeros((len(r), width - n))]) for r in rows], list(right)
        for k, (centre, limit) in enumerate(helpers):
            at = np.zeros((n, width))
            at[:, n * (k + 1) : n * (k + 2)] = -I
            for sign in (1.0, -1.0):
                block = at.copy()
                block[:, :n] = sign * I
                G.append(block)
                h.append(sign * centre)
            total = np.zeros((1, width))
            total[0, n * (k + 1) : n * (k + 2)] = 1
            G.append(total)
            h.append(np.array([limit]))
        A = np.zeros((1, width))
        A[0, :n] = 1
        return A, np.ones(1), np.vstack(G), np.concatenate(h)


FREE = Constraints()


def _checked(assets, c: Constraints) -> None:
    if found := c.conflicts(assets):
        raise Infeasible("; ".join(found))


def _solve(P: np.ndarray, q: np.ndarray, assets: list[str], c: Constraints, row: np.ndarray | None = None, least: float = 0.0) -> np.ndarray:
    """Weights with the least w'Pw/2 + q'w; with ``row`` also ``row @ w >= least``."""
    A, b, G, h = c.system(assets)
    n, width = len(assets), A.shape[1]
    if row is not None:
        G, h = np.vstack([G, np.concatenate([-row, np.zeros(width - n)])]), np.append(h, -least)
    big = np.zeros((width, width))
    big[:n, :n] = P
    return quadratic(big, np.concatenate([q, np.zeros(width - n)]), A, b, G, h)[:n]


def min_variance(cov: np.ndarray, assets: list[str], c: Constraints = FREE) -> np.ndarray:
    _checked(assets, c)
    cov = positive_definite(cov)
    return cleaned(_solve(cov / np.diag(cov).mean(), np.zeros(len(assets)), assets, c), c.min_weight)


def max_return(mu: np.ndarray, assets: list[str], c: Constraints = FREE) -> np.ndarray:
    _checked(assets, c)
    scale = np.abs(mu).max() or 1.0
    return cleaned(_solve(np.zeros((len(mu), len(mu))), -mu / scale, assets, c), c.min_weight)


def efficient_points(mu: np.ndarray, cov: np.ndarray, assets: list[str], c: Constraints = FREE, points: int = 40, rf: float = 0.0, periods: int = PERIODS, only: int | None = None) -> list[dict]:
    """For evenly spaced returns from that of least variance to the largest: the weights of least variance; or ``only`` one
    point of them."""
    if points < 2:
        raise ValueError("an efficient set has two points at least")
    cov = positive_definite(cov)
    low, high = (float(mu @ w) for w in (min_variance(cov, assets, c), max_return(mu, assets, c)))
    out = []
    scale = np.diag(cov).mean()
    targets = np.linspace(low, high, points)
    for target in targets if only is None else targets[only : only + 1]:
        try:
            w = cleaned(_solve(cov / scale, np.zeros(len(mu)), assets, c, mu / (np.abs(mu).max() or 1.0), (target - 1e-12) / (np.abs(mu).max() or 1.0)), c.min_weight)
        except Infeasible:
            continue
        ret, vol = float(mu @ w) * periods, float(np.sqrt(w @ cov @ w) * np.sqrt(periods))
        out.append({"target": target, "annual_return": ret, "annual_volatility": vol, "sharpe": (ret - rf) / vol if vol > 0 else 0.0, "weights": w})
    if not out:
        raise Infeasible("no point of the efficient set is feasible")
    return out


def max_sharpe(mu, cov, assets, c: Constraints = FREE, rf: float = 0.0, points: int = 60) -> np.ndarray:
    return max(efficient_points(mu, cov, assets, c, points, rf), key=lambda p: p["sharpe"])["weights"]


def _with_tail(losses: np.ndarray, peaks: bool, assets: list[str], c: Constraints, alpha: float) -> np.ndarray:
    """Linear program for the mean of the worst ``alpha``: of returns, or with ``peaks`` of falls from the running peak of
    the summed returns. Box and group constraints hold."""
    T, n = losses.shape
    A0, b, G0, h0 = c.system(assets)
    base = A0.shape[1]
    width = base + 1 + T + (T if peaks else 0)
    z, y, u = base, base + 1 + np.arange(T), base + 1 + T + np.arange(T)
    q = np.zeros(width)
    q[z], q[y] = 1, 1 / (alpha * T)
    A = np.hstack([A0, np.zeros((1, width - base))])
    over = np.zeros((T, width))  # y >= loss - z
    over[:, z], over[np.arange(T), y] = -1, -1
    above = np.zeros((T, width))
    above[np.arange(T), y] = -1
    rows, right = [np.hstack([G0, np.zeros((len(G0), width - base))]), over, above], [h0, np.zeros(T), np.zeros(T)]
    if peaks:
        total = np.cumsum(losses, 0)
        over[:, :n], over[np.arange(T), u] = -total, 1
        peak, rising = np.zeros((T, width)), np.zeros((T, width))
        peak[:, :n], peak[np.arange(T), u] = total, -1
        rising[np.arange(T), u] = -1
        rising[np.arange(1, T), u[:-1]] = 1
        rows += [peak, rising]
        right += [np.zeros(T), np.zeros(T)]
    else:
        over[:, :n] = -losses
    scale = np.abs(losses).mean() or 1.0
    for r in rows[1:]:
        r[:, :n] /= scale
    return cleaned(quadratic(1e-12 * np.eye(width), q, A, b, np.vstack(rows), np.concatenate(right), tolerance=1e-9)[:n], c.min_weight)


def min_cvar(returns, assets, c: Constraints = FREE, alpha: float = 0.05) -> np.ndarray:
    _checked(assets, c)
    return _with_tail(returns, False, assets, c, alpha)


def min_cdar(returns, assets, c: Constraints = FREE, alpha: float = 0.05) -> np.ndarray:
    _checked(assets, c)
    return _with_tail(returns, True, assets, c, alpha)


def _unbounded(name: str, c: Constraints, warnings: list[str]) -> None:
    if c.extra() or c.min_weight != 0 or c.max_weight != 1:
        warnings.append(f"{name} does not take constraints; they were left aside")


@dataclass
class Known:
    """What a solver may know of a group: means and covariances, Gerber covariances, or the returns."""

    mu: np.ndarray | None = None
    cov: np.ndarray | None = None
    gerber: np.ndarray | None = None
    returns: np.ndarray | None = None

    @classmethod
    def of(cls, returns: np.ndarray) -> "Known":
        return cls(returns.mean(0), np.atleast_2d(np.cov(returns.T)), gerber(returns), returns)


def _parity(k, assets, c, rf, warnings):
    _unbounded("RiskParity", c, warnings)
    w = risk_parity(k.cov)
    if np.abs(risk_shares(w, k.cov) - 1 / len(w)).max() > 1e-5:
        warnings.append("RiskParity: shares of risk are not equal")
    return w


def _free(name: str, solve: Callable):
    def run(k, assets, c, rf, warnings):
        _unbounded(name, c, warnings)
        return solve(k)

    return run


def _gerber_hrp(k):
    return hierarchical(k.gerber, lambda at, w: w @ k.gerber[np.ix_(at, at)] @ w, np.diag(k.gerber))


def _inverse(k):
    inverse = 1 / np.diag(k.gerber)
    return inverse / inverse.sum()


def _wide(c: Constraints) -> Constraints:
    return Constraints(**(asdict(c) | {"min_weight": min(c.min_weight, -1.0), "max_weight": max(c.max_weight, 1.0)}))


#: The strategies' names.
STRATEGIES: dict[str, Callable] = {
    "Markowitz_MaxSharpe": lambda k, assets, c, rf, warnings: max_sharpe(k.mu, k.cov, assets, c, rf),
    "Markowitz_MinVar": lambda k, assets, c, rf, warnings: min_variance(k.cov, assets, c),
    "RiskParity": _parity,
    "GMV": lambda k, assets, c, rf, warnings: min_variance(k.cov, assets, _wide(c)),
    "HRP": _free("HRP", lambda k: hrp(k.cov)),
    "HRP_CVaR": _free("HRP_CVaR", lambda k: hrp_cvar(k.returns)),
    "Gerber_InvVar": _free("Gerber_InvVar", _inverse),
    "Gerber_HRP": _free("Gerber_HRP", _gerber_hrp),
    "MinCVaR": lambda k, assets, c, rf, warnings: min_cvar(k.returns, assets, c),
    "MinCDaR": lambda k, assets, c, rf, warnings: min_cdar(k.returns, assets, c),
}
#: What each strategy has to know; the others get means and covariances.
BY_GERBER, BY_RETURNS, BY_TAIL = frozenset({"Gerber_InvVar", "Gerber_HRP"}), frozenset({"HRP_CVaR", "MinCVaR", "MinCDaR"}), frozenset({"MinCVaR", "MinCDaR"})
#: Dates of a linear program, and assets of a hierarchy, that one task takes.
PROGRAM_DATES, MATRIX_ASSETS = 600, 500
TOO_FEW = "needs two assets and two dates"


def solve(strategy: str, known: Known | np.ndarray, assets: list[str], c: Constraints = FREE, rf: float = 0.0) -> tuple[np.ndarray | None, list[str]]:
    """Weights, or none, and what went wrong or was left aside; a failure never stops other strategies."""
    warnings: list[str] = []
    try:
        w = STRATEGIES[strategy](known if isinstance(known, Known) else Known.of(known), assets, c, rf, warnings)
        if len(w) != len(assets) or not np.isfinite(w).all():
            raise Infeasible("the weights are not finite")
        return w, warnings
    except (Infeasible, np.linalg.LinAlgError, ZeroDivisionError, FloatingPointError) as error:
        return None, [*warnings, f"{strategy}: {error}"]


WEIGHTS = "grp string, strategy string, ticker string, weight double, warning string"


def matrix(group: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
    """The returns of a group by date and ticker, complete dates only, tickers in order."""
    wide = group.pivot_table(index="date", columns="ticker", values="return", aggfunc="first").dropna()
    return wide.to_numpy(), list(wide.columns)


def square(group: pd.DataFrame, column: str) -> tuple[np.ndarray, list[str]]:
    """A matrix from its rows ``i``, ``j`` and the column, tickers in order."""
    wide = group.pivot(index="i", columns="j", values=column).sort_index()
    return wide[list(wide.index)].to_numpy(), list(wide.index)


def told(grp, strategy: str, w: np.ndarray | None, assets: list[str], warnings: list[str]) -> pd.DataFrame:
    text = json.dumps(warnings) if warnings else None
    if w is None:
        return pd.DataFrame({"grp": [grp], "strategy": [strategy], "ticker": [None], "weight": [np.nan], "warning": [text]})
    return pd.DataFrame({"grp": grp, "strategy": strategy, "ticker": assets, "weight": w, "warning": text})


def by_moments(part: pd.DataFrame) -> tuple[Known, list[str], bool]:
    """What the rows of ``moments`` say of a group; false if its dates or assets are too few."""
    cov, assets = square(part, "cov")
    return Known(part.groupby("i")["mean"].first().sort_index().to_numpy(), cov), assets, len(assets) > 1 and int(part["dates"].iloc[0]) > 1


def by_gerber(part: pd.DataFrame) -> tuple[Known, list[str], bool]:
    g, assets = square(part, "gerber")
    return Known(gerber=g), assets, len(assets) > 1 and bool(np.isfinite(np.diag(g).astype(float)).all())


def by_returns(part: pd.DataFrame) -> tuple[Known, list[str], bool]:
    r, assets = matrix(part)
    fits = min(r.shape) > 1
    return Known(returns=r), assets, fits


def _solved(rows: DataFrame, names: list[str], read: Callable, split: bool, constraints: Constraints, rf: float, counter=None) -> DataFrame:
    """The strategies of each ``grp`` in one task, or with ``split`` each in one of its own. ``counter`` is an accumulator of
    the groups that are done, times their strategies."""
    if not names:
        return rows.sparkSession.createDataFrame([], WEIGHTS)
    rows = rows.withColumn("own", F.explode(F.array(*map(F.lit, names))) if split else F.lit("all"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own, grp = part["own"].iloc[0], part["grp"].iloc[0]
        known, assets, fits = read(part)
        out = []
        for strategy in names if own == "all" else [own]:
            w, warnings = solve(strategy, known, assets, constraints, rf) if fits else (None, [f"{strategy}: {TOO_FEW}"])
            out.append(told(grp, strategy, w, assets, warnings))
        if counter is not None:
            counter.add(len(out))
        return pd.concat(out).astype({"weight": float})

    return rows.groupBy("grp", "own").applyInPandas(run, WEIGHTS)


def _by_tree(matrix: DataFrame, name: str, constraints: Constraints) -> DataFrame:
    """Hierarchical weights of one whole history with many assets."""
    from .linkage import hierarchical_weights

    warnings: list[str] = []
    _unbounded(name, constraints, warnings)
    text = json.dumps(warnings) if warnings else None
    return matrix.sparkSession.createDataFrame([("all", name, t, w, text) for t, w in hierarchical_weights(matrix).items()], WEIGHTS)


def _by_planes(returns: DataFrame, names: list[str], constraints: Constraints) -> DataFrame:
    """The strategies of a tail over one whole history, by cutting planes."""
    from .tails import least_tail

    spark, rows = returns.sparkSession, []

    def system(assets: list[str]):
        _checked(assets, constraints)
        return constraints.system(assets)

    for name in names:
        try:
            weights, _, _ = least_tail(returns, system, name == "MinCDaR", least=constraints.min_weight)
            rows += [("all", name, t, w, None) for t, w in weights.items()]
        except (Infeasible, np.linalg.LinAlgError) as error:
            rows.append(("all", name, None, None, json.dumps([f"{name}: {error}"])))
    return spark.createDataFrame(rows, WEIGHTS)


def optimize(returns: DataFrame, strategies: Iterable[str] = tuple(STRATEGIES), constraints: Constraints = FREE, rf: float = 0.0, by: str | None = None, known: DataFrame | None = None, counter=None) -> DataFrame:
    """``strategy, ticker, weight, warning`` for each group of ``by``; without ``by`` of the whole history.

    ``returns`` holds ``date, ticker, return``. Spark makes means, covariances and Gerber covariances, and a solver gets a
    row for each pair of tickers; ``known``, if given, holds the moments of the groups. The least tails of one history of
    more than ``PROGRAM_DATES`` dates are found by cutting planes; shorter ones and those of groups, whose linear programs
    have a row for each date, and HRP_CVaR get the returns of their group. Hierarchies of more than ``MATRIX_ASSETS`` assets
    of one history are made by ``linkage``. A strategy that fails has one row, without
    ticker and weight. ``counter``, an accumulator, counts the groups and strategies that tasks have solved.
    """
    from .moments import comoves, moments

    names = list(strategies)
    if unknown := set(names) - STRATEGIES.keys():
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    rows = returns.select((F.col(by).cast("string") if by else F.lit("all")).alias("grp"), "date", "ticker", "return")
    if known is None:  # read several times
        rows = stored(rows, "returns")
    plain = [n for n in names if n not in BY_GERBER | BY_RETURNS]
    signs = [n for n in names if n in BY_GERBER]
    planes = [n for n in names if n in BY_TAIL] if by is None and BY_TAIL & set(names) and rows.select("date").distinct().count() > PROGRAM_DATES else []
    whole = [n for n in names if n in BY_RETURNS and n not in planes]
    parts = []
    trees = {"HRP", "Gerber_HRP"} & set(names) if by is None else set()
    if trees and rows.select("ticker").distinct().count() > MATRIX_ASSETS:
        from .covariance import covariance, gerber as signs_of

        for name in sorted(trees):
            parts.append(_by_tree(covariance(rows) if name == "HRP" else signs_of(rows), name, constraints))
        plain, signs = [n for n in plain if n not in trees], [n for n in signs if n not in trees]
    if plain:
        found = known.withColumn("grp", F.col(by).cast("string")) if known is not None else moments(rows, ("grp",))
        parts.append(_solved(found, plain, by_moments, by is None, constraints, rf, counter))
    if signs:
        parts.append(_solved(comoves(rows, ("grp",)), signs, by_gerber, by is None, constraints, rf, counter))
    if whole:
        parts.append(_solved(rows, whole, by_returns, by is None, constraints, rf, counter))
    if planes:
        parts.append(_by_planes(rows, planes, constraints))
    out = reduce(DataFrame.unionByName, parts)
    if known is None and plain + signs:  # a group without a date that all its tickers share has no moments
        lone = rows.select("grp").distinct().join(aligned(rows, "return", ("grp",)).select("grp").distinct(), "grp", "left_anti")
        few = F.to_json(F.array(F.concat("strategy", F.lit(f": {TOO_FEW}"))))
        lone = lone.withColumn("strategy", F.explode(F.array(*map(F.lit, plain + signs))))
        out = out.unionByName(lone.select("grp", "strategy", F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("double").alias("weight"), few.alias("warning")))
    out = out.withColumn("weight", F.when(F.col("ticker").isNotNull(), F.col("weight")))
    return out.withColumnRenamed("grp", by) if by else out.drop("grp")


def closed_form(known: DataFrame, by: str) -> DataFrame:
    """``by, ticker, weight``: least variance without bounds for each group of ``moments``, by the pseudo-inverse."""
    kind = known.schema[by].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        cov, assets = square(part, "cov")
        try:
            w = least_variance(cov)
        except (Infeasible, np.linalg.LinAlgError):
            w = np.full(len(assets), np.nan)
        return pd.DataFrame({by: part[by].iloc[0], "ticker": assets, "weight": w})

    out = known.groupBy(by).applyInPandas(run, f"{by} {kind}, ticker string, weight double")
    return out.withColumn("weight", F.nanvl("weight", F.lit(None).cast("double")))


def efficient_set(returns: DataFrame, constraints: Constraints = FREE, points: int = 40, rf: float = 0.0) -> DataFrame:
    """A row for each point of the set, with its weights by ticker. Spark makes the means and the covariances; the
    group of a point holds a row for each pair of tickers. Fewer than two points can't be asked for."""
    if points < 2:
        raise ValueError("an efficient set has two points at least")
    from .covariance import covariance, means

    whole = aligned(returns, "return")
    moments = covariance(whole).join(means(whole), F.col("i") == F.col("ticker")).select("i", "j", "cov", "mean")

    moments = moments.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    names = ["point", "target", "annual_return", "annual_volatility", "sharpe", "weights"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        point = int(part["point"].iloc[0])
        cov = part.pivot(index="i", columns="j", values="cov").sort_index()[sorted(part["j"].unique())]
        mu = part.groupby("i")["mean"].first().sort_index()
        try:
            found = efficient_points(mu.to_numpy(), cov.to_numpy(), list(mu.index), constraints, points, rf, only=point)
        except (Infeasible, np.linalg.LinAlgError):  # no such point; the others are solved all the same
            found = []
        return pd.DataFrame([{**p, "point": point, "weights": dict(zip(mu.index, p["weights"]))} for p in found], columns=names)

    schema = "point int, target double, annual_return double, annual_volatility double, sharpe double, weights map<string,double>"
    return moments.groupBy("point").applyInPandas(run, schema)
