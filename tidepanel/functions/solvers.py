"""Small dense problems: at most some hundred assets, solved inside the groups that Spark hands out."""

from __future__ import annotations

import numpy as np


class Infeasible(ValueError):
    """No point meets the constraints, or none was found to the wanted accuracy."""


def quadratic(P, q, A, b, G, h, steps: int = 120, tolerance: float = 1e-10) -> np.ndarray:
    """The least of x'Px/2 + q'x where Ax = b and Gx <= h, by a primal-dual interior point with a corrector.

    A solution is only given back with its residuals and duality gap below the tolerance, relative to the data.
    """
    P, q, A, b, G, h = (np.asarray(x, float) for x in (P, q, A, b, G, h))
    n, p, m = len(q), len(b), len(h)
    scale = 1 + max(np.abs(x).max(initial=0) for x in (q, b, h))
    ridge = 1e-13 * np.eye(n)
    x, y, s, z = np.linalg.lstsq(A, b, rcond=None)[0] if p else np.zeros(n), np.zeros(p), np.ones(m), np.ones(m)
    s = np.maximum(1.0, h - G @ x)

    def direction(K, d, rx, ry, rz, rs):
        # From the rows of s and z what is left is a system in x and y alone.
        right = np.concatenate([-rx - G.T @ ((z * rz - rs) / s), -ry])
        step = np.linalg.solve(K, right)
        dx, dy = step[:n], step[n:]
        ds = -rz - G @ dx
        return dx, dy, ds, (-rs - z * ds) / s

    def longest(v, dv):
        down = dv < 0
        return min(1.0, (-v[down] / dv[down]).min()) if down.any() else 1.0

    for _ in range(steps):
        rx, ry, rz = P @ x + q + A.T @ y + G.T @ z, A @ x - b, G @ x + s - h
        gap = s @ z / max(m, 1)
        if max(np.abs(rx).max(initial=0), np.abs(ry).max(initial=0), np.abs(rz).max(initial=0), gap) <= tolerance * scale:
            return x
        d = z / s
        K = np.block([[P + ridge + (G.T * d) @ G, A.T], [A, -1e-13 * np.eye(p)]])
        try:
            _, _, ds, dz = direction(K, d, rx, ry, rz, s * z)
            a = min(longest(s, ds), longest(z, dz))
            centre = ((s + a * ds) @ (z + a * dz) / max(m, 1) / gap) ** 3 if gap else 0.0
            dx, dy, ds, dz = direction(K, d, rx, ry, rz, s * z + ds * dz - centre * gap)
        except np.linalg.LinAlgError as error:
            raise Infeasible("the system has no solution") from error
        a = 0.995 * min(longest(s, ds), longest(z, dz))
        x, y, s, z = x + a * dx, y + a * dy, s + a * ds, z + a * dz
        if not np.isfinite(x).all():
            break
    loose = 1e-7 * scale
    if np.isfinite(x).all() and max(np.abs(rx).max(initial=0), np.abs(ry).max(initial=0), np.abs(rz).max(initial=0), gap) <= loose:
        return x
    raise Infeasible("no feasible point was found")


def positive_definite(cov: np.ndarray, least: float = 1e-10) -> np.ndarray:
    cov = (cov + cov.T) / 2
    low = np.linalg.eigvalsh(cov)[0]
    return cov if low >= least else cov + (least - low) * np.eye(len(cov))


def least_variance(cov: np.ndarray) -> np.ndarray:
    """The weights of least variance without bounds, in closed form; where the covariances are singular, by their
    pseudo-inverse."""
    w = np.linalg.pinv((cov + cov.T) / 2).sum(1)
    if abs(w.sum()) < 1e-300:
        raise Infeasible("the weights sum to nought")
    return w / w.sum()


def cleaned(weights: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Weights of next to nothing become the least allowed, then all are scaled to sum to 1."""
    weights = np.where(np.abs(weights) < 1e-9, max(least, 0.0), weights)
    total = weights.sum()
    return weights / total if abs(total) > 1e-12 else np.full(len(weights), 1 / len(weights))


def risk_shares(weights: np.ndarray, cov: np.ndarray) -> np.ndarray:
    parts = weights * (cov @ weights)
    return parts / parts.sum() if parts.sum() > 0 else np.full(len(weights), 1 / len(weights))


def risk_parity(cov: np.ndarray, steps: int = 200) -> np.ndarray:
    """Equal shares of risk: the one positive point where w'Sw/2 - mean(log w) is least, by damped Newton steps."""
    S = positive_definite(cov) / np.diag(cov).mean()
    n = len(S)
    w = 1 / np.sqrt(np.diag(S)) / np.sqrt(n)
    for _ in range(steps):
        slope = S @ w - 1 / (n * w)
        step = np.linalg.solve(S + np.diag(1 / (n * w * w)), slope)
        drop = slope @ step
        if drop < 1e-24:
            break
        size = 1.0
        value = w @ S @ w / 2 - np.log(w).mean()
        while (w - size * step <= 0).any() or (v := w - size * step) @ S @ v / 2 - np.log(v).mean() > value - 0.25 * size * drop + 1e-16:
            size /= 2
            if size < 1e-12:
                break
        w = w - size * step
        if (w <= 0).any():
            raise Infeasible("risk parity did not converge")
    return w / w.sum()


def leaves(distance: np.ndarray) -> list[int]:
    """The order of leaves under single linkage: pairs from the closest, the cluster with the smaller member first."""
    n = len(distance)
    cluster = {i: [i] for i in range(n)}
    of = list(range(n))
    i, j = np.triu_indices(n, 1)
    for k in np.lexsort((j, i, distance[i, j])):
        a, b = of[i[k]], of[j[k]]
        if a != b:
            a, b = min(a, b), max(a, b)
            for x in cluster[b]:
                of[x] = a
            cluster[a] += cluster.pop(b)
    return cluster[of[0]] if n else []


def tail(values: np.ndarray, alpha: float = 0.05) -> float:
    """The mean of the worst share ``alpha`` of returns, as a loss."""
    k = alpha * len(values)
    worst = np.sort(values)
    whole = int(np.floor(k + 1e-12))
    rest = worst[whole] * (k - whole) if whole < len(worst) else 0.0
    return float(-(worst[:whole].sum() + rest) / k)


def hierarchical(cov: np.ndarray, cluster_risk, own_risk: np.ndarray) -> np.ndarray:
    """Recursive bisection along the leaves: each half gets weight in inverse proportion to its risk."""
    deviation = np.sqrt(np.diag(cov))
    corr = np.clip(cov / np.outer(deviation, deviation), -1, 1)
    order = leaves(np.sqrt((1 - corr) / 2))
    weights = np.ones(len(cov))
    parts = [order]
    while parts:
        part = parts.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        risk = []
        for half in (left, right):
            inverse = 1 / own_risk[half]
            risk.append(cluster_risk(np.array(half), inverse / inverse.sum()))
        share = 1 - risk[0] / (risk[0] + risk[1])
        weights[left] *= share
        weights[right] *= 1 - share
        parts += [left, right]
    return weights / weights.sum()


def hrp(cov: np.ndarray) -> np.ndarray:
    return hierarchical(cov, lambda at, w: w @ cov[np.ix_(at, at)] @ w, np.diag(cov))


def hrp_cvar(returns: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    own = np.array([max(tail(r, alpha), 1e-12) for r in returns.T])
    return hierarchical(np.cov(returns.T), lambda at, w: max(tail(returns[:, at] @ w, alpha), 1e-12), own)


def gerber(returns: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """Covariance from joint moves beyond a share of the deviation: with less against, over how often each moves."""
    deviation = returns.std(0, ddof=1)
    signs = np.where(returns >= threshold * deviation, 1.0, np.where(returns <= -threshold * deviation, -1.0, 0.0))
    joint = signs.T @ signs
    moves = np.sqrt(np.diag(joint))
    both = np.outer(moves, moves)
    corr = np.divide(joint, both, out=np.eye(len(joint)), where=both > 0)
    return corr * np.outer(deviation, deviation)
