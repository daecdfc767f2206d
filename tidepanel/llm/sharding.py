"""Sharding by a k-d tree over metadata, until leaves reach the target bytes.

A point of the tree is a group of equal texts, weighing the bytes of all its rows, so that copies stay together. Only a
group that outweighs a whole shard is cut, into parts that lie next to each other and so go to no more shards than it
needs and one at either end. A node stands for as many shards as its bytes are targets; it is split, in proportion to the
shards of its halves, along the dimension in which its points lie widest apart, relative to all points, at the weighted
median, which Spark finds for all nodes of a level at once by histograms: the bin that holds the median is divided again
until it holds a single value or next to nothing. Points that tie at the median are told apart by a hash of their text.

Points above ``HEAVY`` of the target, of which there are no more than shards / ``HEAVY``, are too coarse for a median:
each node's heavy points are split first, in the same order, where there is room, and the others fill up both sides. So
a shard's bytes are off by some ``HEAVY`` of the target at most, unless single groups leave no better way. The driver only
sees heavy points and the bins of nodes that are split, as many rows as shards or bins; never light points.

The law is ``bytes``: shards' bytes are nearly equal. ``slot`` numbers a shard's rows from 0 without gaps, by counting
rows in hash buckets first, so no task sorts a whole shard.

Null texts count as empty, of size 1; texts of any length are whole; an empty table gives no rows. Null metadata lies
below all other. Repeated rows and rows that share an id or have none are told apart by a number of their own, and each
gets a slot; which one gets which isn't fixed. Columns besides key, text and metadata are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from .common import drop, numbered, stored, table

SHARDS = 8
#: Bins of a histogram for each node; a median is settled when its bin holds this share of the node or one value.
BINS, SETTLED = 4096, 0.001
#: The share of the target bytes above which a point is placed by itself, and the parts that a target's bytes are cut to.
HEAVY, PARTS = 0.05, 16
#: Rows that one bucket numbers.
BUCKET_ROWS = 50_000


def _beside(points: DataFrame, values: Iterable[tuple], columns: str) -> DataFrame:
    """``points`` of the nodes listed, each with its node's values: a row for each node, of which there are no more than
    shards."""
    return points.join(F.broadcast(points.sparkSession.createDataFrame(list(values), f"node int{columns}")), "node")


def _cuts(points: DataFrame, edges: dict[int, tuple[int, int]], wanted: dict[int, float], settled: dict[int, float], nearest: bool = False) -> dict[int, tuple[int, float | None]]:
    """For each node the first value of ``x`` up to which its points weigh as much as is wanted, to within ``settled``,
    and the weight below it; None where what ties at that value needs no further look. ``edges`` are the range of values.

    With ``nearest`` a value that goes too far by more than half its own weight is left out.
    """
    open_ = {n: (lo, hi, 0.0) for n, (lo, hi) in edges.items()}
    done: dict[int, tuple[int, float | None]] = {}
    while open_:
        some = _beside(points, ((n, lo, hi, max(1.0, (hi - lo + 1) / BINS)) for n, (lo, hi, _) in open_.items()), ", low long, high long, step double")
        some = some.where((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
        bins = some.withColumn("bin", F.floor((F.col("x") - F.col("low")).cast("double") / F.col("step")).cast("int"))
        rows = bins.groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        by_node: dict[int, list[Row]] = {}
        for r in sorted(rows, key=lambda r: r["lo"]):
            by_node.setdefault(r["node"], []).append(r)
        left = {}
        for n, (lo, _, below) in open_.items():
            upto = below
            done[n] = (by_node[n][-1]["hi"] if n in by_node else lo, None)  # all of it, if it doesn't weigh as much
            for r in by_node.get(n, ()):
                before, upto = upto, upto + float(r["w"])
                if upto >= wanted[n]:
                    if r["lo"] == r["hi"]:
                        done[n] = (r["hi"] - (nearest and upto - wanted[n] > float(r["w"]) / 2), before)
                    elif float(r["w"]) <= settled[n]:
                        done[n] = (r["hi"], None)
                    else:
                        left[n] = (r["lo"], r["hi"], before)
                    break
        open_ = left
    return done


def _deal(heavy: list[dict], axis: str, wanted: float, weight: float) -> None:
    """Says of each heavy point of a node whether it goes left: up to their own median, if there is room on that side."""
    goal = wanted / weight * sum(h["weight"] for h in heavy)
    room = {True: wanted, False: weight - wanted}
    left = 0.0
    for h in sorted(heavy, key=lambda h: (h[axis], h["tie"], h["part"])):
        side = left + h["weight"] / 2 <= goal
        if room[side] < h["weight"] and room[not side] > room[side]:
            side = not side
        room[side] -= h["weight"]
        left += h["weight"] * side
        h["left"] = side


def shard(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", dimensions: dict[str, Column] | None = None) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``shard`` and ``slot``: as many shards as are given, or as leaves of
    ``target_bytes`` are needed. ``dimensions`` are numbers, by default the size, and the source and the language in the
    order of a hash, as names have no distances."""
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    if dimensions is None:
        named = lambda c: F.coalesce(F.xxhash64(c).bitwiseAND(0xFFFFFFFF), F.lit(-1))
        dimensions = {"size": F.octet_length(body).cast("long"), **{c: F.when(F.col(c).isNull(), -1).otherwise(named(F.col(c))) for c in ("source", "lang") if c in df.columns}}
    names = [f"d_{n}" for n in dimensions]
    rows = df.select(
        F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest"), *(d.cast("long").alias(n) for n, d in zip(names, dimensions.values()))
    )
    rows = numbered(rows, "r")
    # A group's place is the least of its rows' in each dimension.
    places = [F.min(n).alias(n) for n in names]
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("weight"), *places), "groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    if target_bytes is not None:
        shards = max(1, -(-total // target_bytes))
    shards = shards or SHARDS
    target = max(1.0, total / shards)
    # Of groups above a target there are no more than shards.
    large = stored(groups.where(F.col("weight") > target).select("digest", F.ceil(F.col("weight") * PARTS / target).cast("int").alias("parts")), "large")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("r"), "parts")).cast("int").alias("part")
    in_parts = rows.join(F.broadcast(large), "digest").select("*", part).groupBy("digest", "part").agg(F.sum("size").alias("weight"), *places)
    points = groups.join(F.broadcast(large), "digest", "left_anti").withColumn("part", F.lit(0)).unionByName(in_parts)
    points = stored(points.select("digest", "part", "weight", *names, F.shiftright(F.xxhash64("digest"), 2).alias("tie"), F.lit(0).alias("node")), "points")
    heavy = [r.asDict() for r in points.where(F.col("weight") > HEAVY * target).collect()]
    light = stored(points.where(F.col("weight") <= HEAVY * target), "light")
    ends = points.agg(*(F.max(n) - F.min(n) for n in names)).first()
    open_, done = ({0: shards} if total and shards > 1 else {}), False
    while open_:
        own = {n: [h for h in heavy if h["node"] == n] for n in open_}
        ranges = [f(c).alias(f"{f.__name__}_{c}") for c in (*names, "tie") for f in (F.min, F.max)]
        spans = {r["node"]: r.asDict() for r in _beside(light, ((n,) for n in open_), "").groupBy("node").agg(F.sum("weight").alias("w"), *ranges).collect()}
        axis, wanted, parts = {}, {}, {}
        for n, count in open_.items():
            values = {c: [*(spans[n][f"{f}_{c}"] for f in ("min", "max") if n in spans), *(h[c] for h in own[n])] for c in names}
            wide = lambda i: (max(values[names[i]], default=0) - min(values[names[i]], default=0)) / (ends[i] or 1)
            axis[n] = max(range(len(names)), key=lambda i: (wide(i), -i))
            weight = float(spans[n]["w"] if n in spans else 0) + sum(h["weight"] for h in own[n])
            parts[n] = count // 2
            goal = weight * parts[n] / count
            if own[n]:
                _deal(own[n], names[axis[n]], goal, weight)
            wanted[n] = max(0.0, goal - sum(h["weight"] for h in own[n] if h["left"]))
        some = [n for n in open_ if n in spans]
        little = {n: SETTLED * float(spans[n]["w"]) for n in some}
        if some:
            along = _beside(light, ((n, axis[n] + 1) for n in some), ", axis int").withColumn("x", F.element_at(F.array(*names), F.col("axis")))
            cut = _cuts(along, {n: tuple(spans[n][f"{f}_{names[axis[n]]}"] for f in ("min", "max")) for n in some}, {n: wanted[n] for n in some}, little)
            # What ties at that value is split by hash.
            tied = {n: (v, below) for n, (v, below) in cut.items() if below is not None}
            by_hash = {}
            if tied:
                equal = _beside(along, ((n, v) for n, (v, _) in tied.items()), ", at long").where("x = at").select("node", "weight", F.col("tie").alias("x"))
                by_hash = {n: v for n, (v, _) in _cuts(equal, {n: (spans[n]["min_tie"], spans[n]["max_tie"]) for n in tied}, {n: wanted[n] - tied[n][1] for n in tied}, little, nearest=True).items()}
            rule = [(n, axis[n] + 1, cut[n][0], by_hash.get(n, (1 << 63) - 1), n + parts[n]) for n in some]
            right = (F.col("x") > F.col("at")) | ((F.col("x") == F.col("at")) & (F.col("tie") > F.col("tie_at")))
            moved = _beside(light, rule, ", axis int, at long, tie_at long, other int").withColumn("x", F.element_at(F.array(*names), F.col("axis")))
            moved = moved.select("digest", "part", "weight", *names, "tie", F.when(right, F.col("other")).otherwise(F.col("node")).cast("int").alias("node"))
            if done:
                moved = moved.unionByName(light.join(F.broadcast(spark.createDataFrame([(n,) for n in some], "node int")), "node", "left_anti"))
            before, light = light, stored(moved, "light")
            drop(before)
        for n in open_:
            for h in own[n]:
                h["node"] = n if h.pop("left") else n + parts[n]
        halves = {m: c for n, count in open_.items() for m, c in ((n, parts[n]), (n + parts[n], count - parts[n]))}
        open_ = {m: c for m, c in halves.items() if c > 1}
        done = done or len(open_) < len(halves)
    placed = light.select("digest", "part", F.col("node").alias("shard"))
    if heavy:
        placed = placed.unionByName(spark.createDataFrame([(h["digest"], h["part"], h["node"]) for h in heavy], "digest binary, part int, shard int"))
    # One row for each part of a large group and for each other group.
    dealt = rows.join(F.broadcast(large), "digest", "left").select("*", part).join(placed, ["digest", "part"], "left")
    out = stored(dealt.select("r", "key", "size", "text_crc32", "shard"), "placed")
    drop(rows, groups, large, points, light)
    return _slots(out).select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")


def _slots(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0: a bucket's rows follow those of the buckets before it."""
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS)) * 4
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("r"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("r")
    placed = rows.withColumn("place", F.row_number().over(inside))
    return placed.join(first, ["shard", "bucket"]).withColumn("slot", (F.col("first") + F.col("place") - 1).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
