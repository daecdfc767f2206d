"""Gradient-boosted trees that grow by leaves, over quantile bins.

Features are binned once, by quantiles of the training rows. A tree grows at the leaf whose best cut gains most, until it
has ``leaves`` leaves or nothing gains. Cuts are found in histograms: the sums of the gradients, and the counts, of a
leaf's rows by feature and bin. In Spark each task adds up the histograms of its rows, tasks that hold a leaf and feature
add up those, and the driver gets one histogram for each leaf and feature, of a size that the settings bound; no row
reaches it. Growing by leaves would take a job for each cut, so a job works out all leaves that may be cut next; the order
in which they are cut is then told from their gains, and comes out as if it had been followed one by one.

Rows are packed as blocks of arrays, with the score of the trees so far; the blocks are written anew every few trees. The
same growth runs in one task over arrays, for a model for each ticker. Equal gains, to ten digits, go to the first feature
and bin, so the order in which sums are made does not matter. Rows are drawn for each tree by a hash of their key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..shared import drop, stored


@dataclass(frozen=True)
class Settings:
    trees: int = 400
    step: float = 0.03
    leaves: int = 31
    depth: int = -1
    least_child: int = 40
    bagging: float = 0.8
    columns: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    stop_after: int = 40
    bins: int = 255
    seed: int = 42


ALIKE = 1e-10
#: Trees after which the scores of the blocks are written anew.
REFRESH = 8


def drawn(key: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """Whether each row takes part in a tree: a share ``bagging`` of them, by a hash of key, tree and seed."""
    if settings.bagging >= 1:
        return np.ones(len(key), bool)
    x = key.view(np.uint64) + np.uint64((settings.seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(settings.bagging * (1 << 64)))


def features_of(tree: int, n: int, settings: Settings) -> np.ndarray:
    """The features that a tree may cut, in order."""
    taken = max(1, int(np.ceil(n * settings.columns)))
    return np.sort(np.random.default_rng((settings.seed, tree)).permutation(n)[:taken])


@dataclass
class Tree:
    """Nodes by number, 0 the root. A row goes left if its bin is at most the cut; ``left`` is -1 at a leaf."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        for side in (self.left, self.right):
            side[node] = len(self.left)
            for column, empty in ((self.feature, 0), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.depth, self.depth[node] + 1)):
                column.append(empty)
        return self.left[node], self.right[node]

    def locate(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, cut, left, right = map(np.asarray, (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        going = np.flatnonzero(left[at] >= 0)
        while len(going):
            here = at[going]
            at[going] = np.where(bins[going, feature[here]] <= cut[here], left[here], right[here])
            going = going[left[at[going]] >= 0]
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.locate(bins)]


def shrunk(gradient, l1: float):
    return np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0.0)


def gains(gradient: np.ndarray, count: np.ndarray, settings: Settings) -> np.ndarray:
    """What each cut of a leaf gains, from its histograms by feature and bin; minus infinity where a side is too small."""
    left_g, left_n = np.cumsum(gradient, axis=1), np.cumsum(count, axis=1)
    all_g, all_n = left_g[:, -1:], left_n[:, -1:]
    score = lambda g, n: shrunk(g, settings.l1) ** 2 / (n + settings.l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = score(left_g, left_n) + score(all_g - left_g, all_n - left_n) - score(all_g, all_n)
    fits = (left_n >= max(1, settings.least_child)) & (all_n - left_n >= max(1, settings.least_child))
    return np.where(fits, out, -np.inf)


@dataclass
class Leaf:
    gradient: float
    count: float
    gain: float
    feature: int
    cut: int

    def value(self, settings: Settings) -> float:
        return float(-settings.step * shrunk(self.gradient, settings.l1) / (self.count + settings.l2))


def leaf_of(histogram: tuple[np.ndarray, np.ndarray], features: np.ndarray, depth: int, settings: Settings) -> Leaf:
    gradient, count = histogram
    gained = gains(gradient, count, settings)
    best = float(gained.max()) if settings.depth < 0 or depth < settings.depth else -np.inf
    total = (float(gradient[0].sum()), float(count[0].sum()))
    if not best > 1e-12:
        return Leaf(*total, -np.inf, -1, -1)
    feature, cut = divmod(int(np.flatnonzero(gained >= best * (1 - ALIKE))[0]), gained.shape[1])
    return Leaf(*total, best, int(features[feature]), cut)


Histograms = Callable[[Tree, list[int]], dict[int, tuple[np.ndarray, np.ndarray]]]


def grown(histograms: Histograms, root: tuple[np.ndarray, np.ndarray], features: np.ndarray, settings: Settings) -> tuple[Tree, int]:
    """A tree, and how many leaves it has. Leaves that may be cut are worked out together."""
    tree = Tree()
    known = {0: leaf_of(root, features, 0, settings)}
    while True:
        leaves, cuts = [0], []
        while len(leaves) < settings.leaves:
            best = max(known[i].gain for i in leaves)
            if best == -np.inf:
                break
            node = next(i for i in leaves if known[i].gain >= best * (1 - ALIKE))
            if tree.left[node] < 0 or tree.left[node] not in known:
                break
            cuts.append(node)
            leaves.remove(node)
            leaves += [tree.left[node], tree.right[node]]
        open_ = [i for i in leaves if known[i].gain > -np.inf and tree.left[i] < 0]
        if len(leaves) >= settings.leaves or not open_:
            break
        open_ = sorted(open_, key=lambda i: -known[i].gain)[: settings.leaves - len(leaves)]
        wanted = [child for i in sorted(open_) for child in tree.split(i, known[i].feature, known[i].cut)]
        known |= {i: leaf_of(h, features, tree.depth[i], settings) for i, h in histograms(tree, wanted).items()}
    # Only what was cut in order stays.
    out, names = Tree(), {0: 0}
    for node in cuts:
        names[tree.left[node]], names[tree.right[node]] = out.split(names[node], tree.feature[node], tree.cut[node])
    for node in leaves:
        out.value[names[node]] = known[node].value(settings)
    return out, len(leaves)


@dataclass
class Model:
    """The trees that are used, the mean that they start from, and the edges between the bins of each feature."""

    base: float
    trees: list[Tree]
    edges: list[np.ndarray]
    losses: list[float]

    def scores(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.edges)
        return self.base + sum((t.scores(bins) for t in self.trees), np.zeros(len(bins)))

    def importances(self) -> np.ndarray:
        """The share of each feature in the cuts of all trees."""
        cuts = np.zeros(len(self.edges))
        for tree in self.trees:
            for feature, left in zip(tree.feature, tree.left):
                cuts[feature] += left >= 0
        return cuts / (cuts.sum() or 1.0)


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many of its feature's edges are below it."""
    out = np.zeros(values.shape, np.uint8)
    for i, edge in enumerate(edges):
        out[:, i] = np.searchsorted(edge, values[:, i], side="left")
    return out


class Block:
    """Rows as arrays: bins, targets, keys, whether they only stop the growth, and the scores so far."""

    def __init__(self, bins: np.ndarray, target: np.ndarray, key: np.ndarray, stops: np.ndarray, score: np.ndarray):
        self.bins, self.target, self.key, self.stops, self.score = bins, target, key, stops, score

    def histograms(self, tree: Tree, wanted: list[int], number: int, features: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradients and counts by wanted node, feature and bin."""
        place = np.full(len(tree.left), -1)
        place[wanted] = np.arange(len(wanted))
        node = place[tree.locate(self.bins)]
        rows = np.flatnonzero((node >= 0) & ~self.stops & drawn(self.key, number, settings))
        shape = (len(wanted), len(features), settings.bins)
        cells = (node[rows, None] * shape[1] + np.arange(shape[1])) * shape[2] + self.bins[rows][:, features]
        gradient = np.repeat(self.score[rows] - self.target[rows], shape[1])
        size = shape[0] * shape[1] * shape[2]
        return np.bincount(cells.ravel(), gradient, size).reshape(shape), np.bincount(cells.ravel(), minlength=size).reshape(shape).astype(float)

    def loss(self) -> np.ndarray:
        """The sum of squared errors of the rows that stop the growth, and their number."""
        off = (self.score - self.target)[self.stops]
        return np.array([float(off @ off), float(len(off))])


class Arrays:
    """Where the rows of one task are."""

    def __init__(self, block: Block, settings: Settings):
        self.block, self.settings = block, settings

    def ask(self, tree: Tree, wanted: list[int], number: int, features: np.ndarray):
        gradient, count = self.block.histograms(tree, wanted, number, features, self.settings)
        return {w: (gradient[i], count[i]) for i, w in enumerate(wanted)}, self.block.loss()

    def add(self, tree: Tree) -> None:
        self.block.score = self.block.score + tree.scores(self.block.bins)

    def done(self) -> None:
        pass


PACKED = "n int, bins binary, target binary, key binary, stops binary, score binary"


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[Block]:
    for n, *parts in zip(*(batch.column(c).to_pylist() for c in ("n", "bins", "target", "key", "stops", "score"))):
        bins, target, key, stops, score = (np.frombuffer(p, kind) for p, kind in zip(parts, (np.uint8, np.float64, np.int64, np.bool_, np.float64)))
        yield Block(bins.reshape(n, width), target, key, stops, score)


class Tables:
    """Where the rows of a packed table are."""

    def __init__(self, blocks: DataFrame, width: int, settings: Settings):
        self.blocks, self.width, self.settings, self.new = blocks, width, settings, []

    def ask(self, tree: Tree, wanted: list[int], number: int, features: np.ndarray):
        width, settings, new = self.width, self.settings, list(self.new)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, loss = None, np.zeros(2)
            for batch in batches:
                for block in _unpacked(batch, width):
                    block.score = block.score + sum((t.scores(block.bins) for t in new), np.zeros(len(block.bins)))
                    found = np.stack(block.histograms(tree, wanted, number, features, settings), axis=2)
                    sums, loss = found if sums is None else sums + found, loss + block.loss()
            if sums is not None:
                nodes, columns = np.divmod(np.arange(len(wanted) * len(features)), len(features))
                blobs = [sums[i, j].tobytes() for i, j in zip(nodes, columns)]
                yield pa.RecordBatch.from_arrays([pa.array([-1, *nodes], pa.int32()), pa.array([-1, *columns], pa.int32()), pa.array([loss.tobytes(), *blobs], pa.binary())], names=["node", "feature", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for *at, blob in zip(*(batch.column(c).to_pylist() for c in ("node", "feature", "sums"))):
                    part = np.frombuffer(blob, np.float64)
                    out[*at] = out[*at] + part if tuple(at) in out else part
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in out], pa.int32()) for i in (0, 1)), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["node", "feature", "sums"])

        kind = "node int, feature int, sums binary"
        rows = self.blocks.mapInArrow(partial, kind).repartition("node", "feature").mapInArrow(added, kind).toArrow()
        shape = (len(features), settings.bins)
        hists = {w: (np.zeros(shape), np.zeros(shape)) for w in wanted}
        loss = np.zeros(2)
        for node, feature, blob in zip(*(rows.column(c).to_pylist() for c in ("node", "feature", "sums"))):
            part = np.frombuffer(blob, np.float64)
            if node < 0:
                loss = part
            else:
                for side, values in zip(hists[wanted[node]], part.reshape(2, settings.bins)):
                    side[feature] = values
        return hists, loss

    def add(self, tree: Tree) -> None:
        self.new.append(tree)
        if len(self.new) < REFRESH:
            return
        new, width = self.new, self.width

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = [(b.score + sum(t.scores(b.bins) for t in new)).tobytes() for b in _unpacked(batch, width)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.binary())], names=batch.schema.names)

        after = stored(self.blocks.mapInArrow(scored, PACKED), "blocks")
        drop(self.blocks)
        self.blocks, self.new = after, []

    def done(self) -> None:
        drop(self.blocks)


def fitted(rows: Arrays | Tables, base: float, edges: list[np.ndarray], settings: Settings = Settings(), progress: Callable[[float], None] = lambda share: None) -> Model:
    """Trees until their number is reached, none gains, or the loss of the rows that stop the growth has not fallen for
    ``stop_after`` trees; what came after its least is dropped. ``progress`` is told a share that never falls."""
    trees: list[Tree] = []
    losses: list[float] = []
    least, best = np.inf, 0
    while True:
        number = len(trees)
        features = features_of(number, len(edges), settings)
        root, (squares, n) = rows.ask(Tree(), [0] if number < settings.trees else [], number, features)
        if number and n:
            losses.append(squares / n)
            if losses[-1] < least * (1 - ALIKE):
                least, best = losses[-1], number
            elif number - best >= settings.stop_after:
                break
        if number == settings.trees:
            break
        tree, leaves = grown(lambda tree, wanted: rows.ask(tree, wanted, number, features)[0], root[0], features, settings)
        if leaves == 1:
            break
        trees.append(tree)
        rows.add(tree)
        progress(len(trees) / settings.trees)
    rows.done()
    progress(1.0)
    return Model(base, trees[:best] if losses else trees, edges, losses)


def fit_arrays(values: np.ndarray, target: np.ndarray, key: np.ndarray, stops: np.ndarray, settings: Settings = Settings()) -> Model:
    """A model of the rows of one task."""
    learnt = values[~stops]
    shares = np.arange(1, settings.bins) / settings.bins
    edges = [np.unique(np.quantile(learnt[:, i], shares, method="inverted_cdf")) for i in range(values.shape[1])]
    base = float(target[~stops].mean())
    block = Block(binned(values, edges), target, key, stops, np.full(len(target), base))
    return fitted(Arrays(block, settings), base, edges, settings)


def edges_of(rows: DataFrame, columns: Sequence[str], settings: Settings) -> list[np.ndarray]:
    """The edges between the bins of each column, by approximate quantiles; exact for few rows."""
    shares = [i / settings.bins for i in range(1, settings.bins)]
    found = rows.agg(*(F.percentile_approx(c, shares, 10_000).alias(c) for c in columns)).first()
    return [np.unique(np.array(found[c] or [], float)) for c in columns]


def packed(rows: DataFrame, columns: Sequence[str], edges: list[np.ndarray], base: float, target: str, stops: str, key: Sequence[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))])
                y, k = (batch.column(c).to_numpy() for c in ("y_", "k_"))
                s = batch.column("s_").to_numpy(zero_copy_only=False)
                parts = (binned(values, edges), y.astype(float), k.astype(np.int64), s.astype(bool), np.full(len(y), base))
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["n", "bins", "target", "key", "stops", "score"])

    picked = rows.select(*columns, F.col(target).alias("y_"), F.xxhash64(*key).alias("k_"), F.col(stops).alias("s_"))
    return stored(picked.mapInArrow(run, PACKED), "blocks")


def fit(rows: DataFrame, columns: Sequence[str], settings: Settings = Settings(), target: str = "target_scaled", stops: str = "is_validation", key: Sequence[str] = ("ticker", "date"), progress: Callable[[float], None] = lambda share: None) -> Model:
    """A model of all rows, those marked by ``stops`` only stopping the growth. ``key`` tells rows apart for the draw."""
    learnt = rows.where(~F.col(stops))
    base = learnt.agg(F.avg(target)).first()[0]
    if base is None:
        raise ValueError("there are no rows to learn from")
    edges = edges_of(learnt, columns, settings)
    blocks = packed(rows, columns, edges, base, target, stops, key)
    return fitted(Tables(blocks, len(edges), settings), base, edges, settings, progress)


def predict(rows: DataFrame, columns: Sequence[str], model: Model, out: str = "raw") -> DataFrame:
    """``rows`` with the scores of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(values))], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))


def fit_each(rows: DataFrame, columns: Sequence[str], settings: Settings = Settings(), by: str = "ticker", date: str = "date", keep: Sequence[str] = (), target: str = "target_scaled", train: str = "is_train", stops: str = "is_validation", fit: Callable = fit_arrays) -> DataFrame:
    """A model for each value of ``by``, all in one job: ``by``, ``date``, the columns ``keep`` and ``raw``, the score of
    the rows that aren't trained on, and ``error``; a model that can't be fitted is one row that says why."""
    names = [by, date, *keep]
    schema = T.StructType([T.StructField(f.name, f.dataType) for c in names for f in [rows.schema[c]]] + [T.StructField("raw", T.DoubleType()), T.StructField("error", T.StringType())])
    columns = list(columns)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        try:
            group = group.sort_values(date)
            learnt, tested = group[group[train]], group[~group[train]]
            model = fit(learnt[columns].to_numpy(float), learnt[target].to_numpy(float), learnt["k_"].to_numpy(np.int64), learnt[stops].to_numpy(bool), settings)
            out = tested[names].assign(raw=model.scores(tested[columns].to_numpy(float)), error=None)
        except Exception as error:  # one that fails must not stop the others
            out = pd.DataFrame({c: [group[by].iloc[0] if c == by else None] for c in names}).assign(raw=None, error=f"{type(error).__name__}: {error}")
        return out

    picked = rows.select(*dict.fromkeys([*names, *columns, target, train, stops]), F.xxhash64(by, date).alias("k_"))
    return picked.groupBy(by).applyInPandas(one, schema)


def split_gains(rows: DataFrame, columns: Sequence[str], edges: list[np.ndarray], settings: Settings, target: str = "target_scaled") -> DataFrame:
    """What each first cut of a tree would gain over all rows: ``feature``, ``cut`` (the number of its edge) and ``gain``."""
    spark = rows.sparkSession
    base = rows.agg(F.avg(target)).first()[0] or 0.0
    blocks = packed(rows.withColumn("s_none", F.lit(False)), columns, edges, base, target, "s_none", columns)
    table = Tables(blocks, len(edges), replace(settings, bagging=1.0))
    all_ = np.arange(len(edges))
    (gradient, count), = table.ask(Tree(), [0], 0, all_)[0].values()
    table.done()
    gained = gains(gradient, count, settings)
    found = [(columns[i], int(j), float(gained[i, j])) for i in all_ for j in range(len(edges[i])) if gained[i, j] > -np.inf]
    return spark.createDataFrame(found, "feature string, cut int, gain double")
