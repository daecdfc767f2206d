"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are searched by largest inner product. A vector of the table is scaled by the largest norm and gets one more
component that makes its length 1, a query is scaled to length 1 and gets a 0 there, so that the nearest direction is the
largest product. A pseudo-rotation, three rounds of random signs and a fast Hadamard transform, takes both to a space in
which a vector is hashed to the axis, with its sign, that is nearest. A cell is named by one or more such hashes, the last
of them over the first axes only, so that the number of cells grows with that of the vectors. Each table has rotations
of its own; a query looks into the cells whose axes are nearest to it over all hashes, and what it meets there is ranked
by the exact product, in double precision, on the vectors as they are. The share of the cells that are looked into falls
as their number grows (``Settings``). A query that met fewer vectors than asked for is held against all of them.

Cells are dealt in blocks of neighbouring numbers, so a query crosses to a block once whatever it looks at there. Equal
vectors are one entry with their smallest ids, as many as an answer can hold, so copies cost nothing. A block that holds
much more than its share is split, and its queries go to every part; a part passes on only each query's best.

Vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id take no part; shorter
vectors count as padded with zeros. Rows that repeat an id and its vector count once; rows that share an id and hold different
vectors are rows of their own, each a query with ranks of its own and a candidate of the others. Ties go to the smaller id. A query
with fewer candidates than asked for gets those there are; without candidates, as in an empty table, there are no rows.
Columns besides the id and the vector are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import drop, list_array, offsets_of, ranges, small_batches, stored, table


@dataclass(frozen=True)
class Settings:
    tables: int = 10
    seed: int = 7
    #: Vectors for a cell, at least, on the average.
    cell_rows: int = 3
    #: A query looks into ``reach * (cells / 512) ** -decline`` times as many cells as a table has, over all tables.
    reach: float = 0.75
    decline: float = 0.4
    #: Vectors of a block on the average, and times that above which a block is split.
    block_rows: int = 2048
    share: float = 2.0

    def axes(self, n: int, padded: int) -> list[int]:
        """How many axes each hash of a cell tells apart, each with two signs, for a table of ``n`` vectors."""
        out, cells = [padded], 2 * padded
        while cells * 2 * self.cell_rows <= n:
            out.append(min(padded, 1 << (int(n / self.cell_rows / cells / 2).bit_length() - 1)))
            cells *= 2 * out[-1]
        return out

    def probes(self, cells: int) -> int:
        """Cells of one table that a query looks into."""
        return min(cells, max(1, round(cells * self.reach * (cells / 512) ** -self.decline / self.tables)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n = x.shape[1]
    step = 1
    while step < n:
        pairs = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """Pseudo-rotation ``number`` of the rows; their width is a power of two."""
    signs = np.random.default_rng([seed, number]).integers(0, 2, (3, x.shape[1])) * 2.0 - 1
    for s in signs:
        x = hadamard(x * s)
    return x


def cell(x: np.ndarray, axes: list[int], number: int, seed: int) -> np.ndarray:
    """The cell of each row in table ``number``: for each hash the nearest axis a, as 2a, or 2a + 1 where negative."""
    out = np.zeros(len(x), np.int64)
    for i, m in enumerate(axes):
        y = rotated(x, number * 16 + i, seed)[:, :m]
        at = np.abs(y).argmax(1)
        out = out * (2 * m) + 2 * at + (y[np.arange(len(y)), at] < 0)
    return out


def nearest_cells(x: np.ndarray, axes: list[int], number: int, seed: int, count: int) -> np.ndarray:
    """The ``count`` cells of each row whose axes are nearest to it: least squares of what they fall short of the best."""
    out, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for i, m in enumerate(axes):
        y = rotated(x, number * 16 + i, seed)[:, :m]
        both = np.stack([y, -y], axis=2).reshape(len(y), 2 * m)
        short = (both.max(1, keepdims=True) - both) ** 2
        out = (out[:, :, None] * (2 * m) + np.arange(2 * m)).reshape(len(x), -1)
        loss = (loss[:, :, None] + short[:, None, :]).reshape(len(x), -1)
        if loss.shape[1] > count:
            best = np.argpartition(loss, count - 1, axis=1)[:, :count]
            out, loss = np.take_along_axis(out, best, 1), np.take_along_axis(loss, best, 1)
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, summed the same way whatever stands beside them."""
    return (a * b).sum(-1)


def _valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score``: the ``k`` nearest rows to each row that is a query."""
    spark, s = df.sparkSession, settings
    small_batches(spark)
    rows = df.where(_valid(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    w = Window.partitionBy("v").orderBy("id")
    # Of equal vectors an answer can hold k, besides the query itself; rank() <= k + 1 is cut before the shuffle too.
    kept = rows.groupBy("v", "id").agg(F.max("asks").alias("asks"))
    ids = kept.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asks = kept.groupBy("v").agg(F.max("asks").alias("asks"))
    entries = stored(ids.join(asks, "v").select(F.monotonically_increasing_id().alias("no"), F.col("ids")[0].alias("id"), "ids", "v", "asks"), "vectors")
    norm = F.aggregate("v", F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    facts = entries.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"), F.max(F.size("v")).alias("width"), F.sqrt(F.max(norm)).alias("norm")).first()
    width = facts["width"] or 1
    largest, padded = facts["norm"] or 1.0, 1 << int(width).bit_length()
    axes = s.axes(facts["n"], padded)
    cells = int(np.prod([2 * m for m in axes], dtype=object))
    count = s.probes(cells)
    # As many neighbouring cells as hold about so many vectors are a block.
    span = -(-cells // max(1, -(-facts["n"] // s.block_rows)))
    kind = entries.schema["v"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, padded))
            for i, v in enumerate(batch.column("v").to_pylist()):
                x[i, : len(v)] = v
            length = np.sqrt(dots(x, x))
            asking = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            q = x[asking] / length[asking, None]
            x /= largest
            x[:, width] = np.sqrt(np.maximum(0, 1 - dots(x, x)))
            own = np.stack([cell(x, axes, t, s.seed) for t in range(s.tables)], axis=1)
            looks = np.zeros((len(q), s.tables, count), np.int64)
            for at in range(0, len(q), 64):
                for t in range(s.tables):
                    looks[at : at + 64, t] = nearest_cells(q[at : at + 64], axes, t, s.seed, count)
            # What a query looks at in one block of one table together.
            looks.sort(axis=2)
            flat = looks.ravel()
            block = flat // span
            begins = np.arange(len(flat)) % count == 0
            begins[1:] |= block[1:] != block[:-1]
            first = np.flatnonzero(begins)
            lists = list_array(flat, np.append(first, len(flat)), pa.int64())
            structs = pa.StructArray.from_arrays([pa.array((first // count % s.tables).astype(np.int32)), pa.array(block[first]), lists], names=["tab", "block", "cells"])
            per_row = np.zeros(len(x), np.int64)
            per_row[asking] = np.bincount(first // (count * s.tables), minlength=len(q)) if len(q) else 0
            probes = pa.ListArray.from_arrays(pa.array(offsets_of(per_row), pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column("no"), batch.column("id"), batch.column("v"), list_array(own.ravel(), np.arange(len(x) + 1) * s.tables, pa.int64()), probes], names=["no", "id", "v", "own", "probes"])

    marked = stored(entries.select("no", "id", "v", "asks").mapInArrow(hashed, f"no long, id long, v {kind}, own array<long>, probes array<struct<tab:int,block:long,cells:array<long>>>"), "hashed")
    held = marked.select("no", "id", "v", F.posexplode("own").alias("tab", "cell"))
    held = held.select("no", "id", "v", "tab", F.floor(F.col("cell") / F.lit(span)).alias("block"), F.array("cell").alias("cells"), F.lit(False).alias("asks"))
    probed = marked.where(F.size("probes") > 0).select("no", "id", "v", F.explode("probes").alias("p")).select("no", "id", "v", "p.tab", "p.block", "p.cells", F.lit(True).alias("asks"))
    most = int(s.share * s.block_rows)
    large = held.groupBy("tab", "block").count().where(F.col("count") > most).select("tab", "block", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    large = stored(large, "large")

    def met(held: DataFrame, probed: DataFrame) -> DataFrame:
        """Each query's best of each block, and then of all: ``asker`` and ``rows``."""
        parts = F.coalesce("parts", F.lit(1))
        own = held.join(large, ["tab", "block"], "left").withColumn("part", F.pmod(F.xxhash64("no"), parts).cast("int"))
        ask = probed.join(large, ["tab", "block"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        found = own.unionByName(ask).drop("parts").groupBy("tab", "block", "part").applyInPandas(best, "no long, near array<long>, ids array<long>, scores array<double>")
        # Best first: largest product, then smallest id. An entry met in several tables has one score.
        zipped = F.transform(F.arrays_zip("near", "ids", "scores"), lambda x: F.struct((-x["scores"]).alias("minus"), x["ids"].alias("id"), x["near"].alias("near")))
        lists = found.select("no", zipped.alias("near")).groupBy("no").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
        fresh = F.filter("near", lambda x, i: (i == 0) | (x["near"] != F.col("near")[F.greatest(i - 1, F.lit(0))]["near"]))
        near = lists.select(F.col("no").alias("asker"), F.explode(F.slice(fresh, 1, k + 1)).alias("near")).select("asker", F.col("near.near").alias("no"), F.col("near.minus").alias("minus"))
        rows_of = F.transform("ids", lambda i: F.struct(F.col("minus"), i.alias("vec_id"), F.col("no")))
        return near.join(entries.select("no", "ids"), "no").select("asker", rows_of.alias("rows")).groupBy("asker").agg(F.slice(F.sort_array(F.flatten(F.collect_list("rows"))), 1, k + 1).alias("rows"))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        def matrix(part):
            x = np.zeros((len(part), width))
            for i, v in enumerate(part["v"]):
                x[i, : len(v)] = v
            return x, part["no"].to_numpy(), part["id"].to_numpy()

        asks = group["asks"].to_numpy()
        (c, c_nos, c_ids), (q, q_nos, _) = matrix(group[~asks]), matrix(group[asks])
        # Vectors in the order of their cells, so that what a cell holds is a range.
        own = group["cells"][~asks].str[0].to_numpy(np.int64)
        order = np.lexsort((c_ids, own))
        c, c_nos, c_ids, own = c[order], c_nos[order], c_ids[order], own[order]
        out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for i, cells in enumerate(group["cells"][asks]):
            if cells is None:
                at = np.arange(len(c))
            else:
                first = np.searchsorted(own, cells)
                at = ranges(first, np.searchsorted(own, cells, side="right") - first)
            if not len(at):
                continue
            scores = dots(c[at], q[i])
            if len(at) > k + 9:
                # Ties at the edge all stay, so that the smaller id wins.
                some = scores >= -np.partition(-scores, k)[k]
                at, scores = at[some], scores[some]
            first = np.lexsort((c_ids[at], -scores))[: k + 1]
            out.append((q_nos[i], c_nos[at[first]], c_ids[at[first]], scores[first]))
        return pd.DataFrame({n: pd.Series([x[j] for x in out], dtype="int64" if n == "no" else object) for j, n in enumerate(("no", "near", "ids", "scores"))})

    answers = stored(met(held, probed), "answers")
    # Who met too few vectors is held against all of them, by way of the first table's blocks.
    enough = min(k + 1, facts["ids"] or 0)
    short = marked.where(F.size("probes") > 0).select(F.col("no").alias("asker"), "v").join(answers.where(F.size("rows") >= enough).select("asker"), "asker", "left_anti")
    short = stored(short, "short")
    if not short.isEmpty():
        blocks = F.explode(F.sequence(F.lit(0), F.lit((cells - 1) // span)).cast("array<long>")).alias("block")
        everywhere = short.select(F.col("asker").alias("no"), F.lit(0).cast("long").alias("id"), "v", F.lit(0).alias("tab"), blocks, F.lit(None).cast("array<long>").alias("cells"), F.lit(True).alias("asks"))
        again = met(held.where("tab = 0"), everywhere)
        answers = stored(answers.join(short.select("asker"), "asker", "left_anti").unionByName(again), "refilled")
    drop(marked, large, short)
    askers = kept.where("asks").join(entries.where("asks").select(F.col("no").alias("asker"), "v"), "v").select(F.col("id").alias("query_id"), "asker")
    others = F.slice(F.filter("rows", lambda r: (r["vec_id"] != F.col("query_id")) | (r["no"] != F.col("asker"))), 1, k)
    out = stored(askers, "queries").join(answers, "asker").select("query_id", F.posexplode(others).alias("rank", "row"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("row.vec_id").alias("vec_id"), (-F.col("row.minus")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
