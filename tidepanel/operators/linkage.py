"""Hierarchical risk parity for many assets, from rows of a covariance matrix.

Single linkage is the minimum spanning tree of the distances. It is found by rounds: each component picks its shortest pair
to another one, and these pairs join components, so their number halves at least. A round is one aggregate over the pairs;
the driver gets an edge for each component. Ties are told apart by the pair, so the tree is the one that linking pairs in
order gives. The tree's edges in order give the order of the leaves, which is cut in halves level by level. The risks of
all halves of all levels are one more aggregate: a pair counts for each level at which both of its assets are in one half.
Nothing that grows with the pairs leaves Spark; edges, halves and weights, a few for each asset, do.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..shared import drop, stored


def distances(cov: DataFrame) -> DataFrame:
    """``i``, ``j`` and ``d`` for each pair in order: by correlation, nought to one."""
    own = cov.where("i = j").select(F.col("i").alias("at"), F.sqrt("cov").alias("sd"))
    of = lambda end: own.select(F.col("at").alias(end), F.col("sd").alias(f"sd_{end}"))
    pairs = cov.where("i < j").join(of("i"), "i").join(of("j"), "j")
    corr = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / (F.col("sd_i") * F.col("sd_j"))))
    return pairs.select("i", "j", F.sqrt((1 - corr) / 2).alias("d"))


def spanning_tree(pairs: DataFrame, names: list[str]) -> list[tuple[float, str, str]]:
    """The edges ``d, i, j`` of the minimum spanning tree, in order. ``pairs`` is stored."""
    spark, component, edges = pairs.sparkSession, {n: n for n in names}, set()

    def root(name: str) -> str:
        while component[name] != name:
            component[name] = component[component[name]]
            name = component[name]
        return name

    while len({root(n) for n in names}) > 1:
        at = spark.createDataFrame([(n, root(n)) for n in names], "name string, component string")  # a row for each asset
        of = lambda end: at.select(F.col("name").alias(end), F.col("component").alias(f"c_{end}"))
        apart = pairs.join(of("i"), "i").join(of("j"), "j").where("c_i <> c_j")
        sides = apart.select(F.explode(F.array("c_i", "c_j")).alias("component"), F.struct("d", "i", "j").alias("edge"))
        found = [tuple(r.edge) for r in sides.groupBy("component").agg(F.min("edge").alias("edge")).collect()]
        if not found:
            raise ValueError("there are assets without a distance to the others")
        edges |= set(found)
        for _, i, j in found:
            component[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(edges)


def leaf_order(edges: list[tuple[float, str, str]], names: list[str]) -> list[str]:
    """The leaves under single linkage: of two clusters that are joined, that with the smaller member comes first."""
    parent, following, last = {n: n for n in names}, {}, {n: n for n in names}

    def root(name: str) -> str:
        while parent[name] != name:
            parent[name] = parent[parent[name]]
            name = parent[name]
        return name

    for _, i, j in edges:
        a, b = sorted((root(i), root(j)))  # a root is its cluster's smallest and first member
        parent[b] = a
        following[last[a]], last[a] = b, last[b]
    out = [min(names)] if names else []
    while out and out[-1] in following:
        out.append(following[out[-1]])
    return out


def halves(order: list[str]) -> dict[str, list[int]]:
    """For each leaf the number of its half at each level; the halves 2n + 1 and 2n + 2 are those of n, the whole is 0."""
    out: dict[str, list[int]] = {n: [] for n in order}
    todo = [(0, 0, len(order))]
    while todo:
        n, low, high = todo.pop()
        if high - low > 1:
            middle = low + (high - low) // 2
            for half, a, b in ((2 * n + 1, low, middle), (2 * n + 2, middle, high)):
                for name in order[a:b]:
                    out[name].append(half)
                todo.append((half, a, b))
    return out


def hierarchical_weights(cov: DataFrame) -> dict[str, float]:
    """Weights by asset from rows ``i, j, cov`` of a whole matrix: each half gets weight in inverse proportion to its
    variance under inverse-variance weights."""
    cov = stored(cov.select("i", "j", "cov"), "matrix")
    own = {r.i: r.cov for r in cov.where("i = j").collect()}
    names = sorted(own)
    if len(names) < 2:
        drop(cov)
        return {n: 1.0 for n in names}
    pairs = stored(distances(cov), "pairs")
    order = leaf_order(spanning_tree(pairs, names), names)
    drop(pairs)
    of = halves(order)
    spark = cov.sparkSession
    at = spark.createDataFrame([(n, of[n], 1 / own[n]) for n in names], "name string, halves array<long>, inverse double")
    side = lambda end: at.select(F.col("name").alias(end), F.col("halves").alias(f"h_{end}"), F.col("inverse").alias(f"v_{end}"))
    both = cov.join(side("i"), "i").join(side("j"), "j")
    shared = both.select(F.explode(F.array_intersect("h_i", "h_j")).alias("half"), (F.col("v_i") * F.col("v_j") * F.col("cov")).alias("part"))
    variance = {r.half: r.part for r in shared.groupBy("half").agg(F.sum("part").alias("part")).collect()}
    drop(cov)
    inverse: dict[int, float] = {}
    for n in order:
        for half in of[n]:
            inverse[half] = inverse.get(half, 0.0) + 1 / own[n]
    risk = {half: part / inverse[half] ** 2 for half, part in variance.items()}

    def share(half: int) -> float:
        other = half + 1 if half % 2 else half - 1
        return risk[other] / (risk[half] + risk[other])

    weights = {n: math.prod(map(share, of[n])) for n in order}
    total = sum(weights.values())
    return {n: w / total for n, w in weights.items()}
