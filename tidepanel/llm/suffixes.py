"""Substring dedup by suffix arrays and longest previous factors.

The places of a text are put in the order of the ``length`` bytes that start there (suffix order, as deep as a match has
to be). In that order the nearest place before and the nearest place after that belong to a smaller id hold the longest
earlier matches of a place; if one of them matches in ``length`` bytes, the bytes it covers are a later copy. They go, and
the first copy stays.

One array over all texts would be as large as the corpus, so equal strings are brought together first. A string's anchor
is the least hash of the 16-byte grams inside it; equal strings have equal anchors, and neighbouring strings mostly share
one, so a stretch of text with one anchor is sent as one row, each byte some two to four times. Texts without an anchor
that other ids have are left out, as they can't match. Arrays are made twice by the same function: over the stretches of
the texts that a task reads, whose later copies go and aren't sent any more, so that a passage of any number of texts
leaves a task once; then over the stretches of an anchor, from all tasks. An anchor of more than ``HOT`` texts isn't one
group: its strings are sent one by one, dealt by a hash of their own. A group that is larger than a task's array is taken
in pieces, by id, of which only the first copies are carried on. All matches are of bytes, not of hashes, but for a place
that a text repeats in itself.

Copies of whole texts are told by SHA-256 and take part once, with the least id that they have; copies with larger ids
lose all that is long enough. Null texts are empty; texts shorter than ``length`` bytes keep all; texts of any length are
read whole. Rows without an id come after all others and not one after another; rows that share an id don't remove each
other's bytes. Each row comes out once; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import drop, offsets_of, ranges, release, small_batches, stored, table

LENGTH = 50
GRAM = 16
LAST = (1 << 63) - 1
FACTOR = 0x9E3779B97F4A7C15
#: Texts with one anchor from which its strings are dealt one by one.
HOT = 5000
#: Bytes of one suffix array.
ARRAY = 1 << 20
#: Lots of keys that are compared one after another, so that only a part of what is shuffled is on disk at a time.
LOTS = 2


def bodies(column: pa.BinaryArray) -> Iterator[np.ndarray]:
    """The bytes of each value, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return (whole[a:b] for a, b in zip(offsets, offsets[1:]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(FACTOR)
    h ^= h >> np.uint64(29)
    return h


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the factor and of its inverse, modulo 2 to the 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for factor in (FACTOR, pow(FACTOR, -1, 1 << 64)):
            powers = np.full(size, factor, np.uint64)
            powers[0] = 1
            _POWERS.append(np.cumprod(powers, dtype=np.uint64))
        del _POWERS[:-2]
    return _POWERS[0][:n], _POWERS[1][:n]


def grams(body: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes at each place, from sums of bytes times powers of a factor."""
    n = len(body) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, inverses = _powers(len(body))
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * inverses[:n])


def anchors(body: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each string of ``length`` bytes the least hash of the grams inside it."""
    least, span, width = grams(body, gram), length - gram + 1, 1
    if len(body) < length:
        return np.zeros(0, np.int64)
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: -(span - width)], least[span - width :])
    return least.view(np.int64)


def _changes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the runs of equal ones, and how long each is."""
    at = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)
    return values[at[:-1]], np.diff(at)


def _words_of(body: np.ndarray, places: np.ndarray, length: int) -> list[np.ndarray]:
    """The ``length`` bytes at each place as numbers of eight bytes, the first byte weighing most; the last may overlap."""
    width = min(8, length)
    word = np.zeros(len(body) - width + 1, np.uint64)
    for i in range(width):
        word <<= np.uint64(8)
        word |= body[i : len(body) - width + 1 + i]
    return [word[places + i] for i in (*range(0, length - width, width), length - width)]


def suffix_classes(body: np.ndarray, places: np.ndarray, length: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """The rank of the ``length`` bytes at each of ``places`` among all of these, in suffix order; equal bytes have equal
    ranks. ``hashes``, if they are known, spare the sorting of equal bytes: those of one hash are compared instead."""
    if not len(places):
        return np.zeros(0, np.int64)
    words = _words_of(body, places, length)
    if hashes is not None:
        _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        if all((w == w[first][of]).all() for w in words):
            rank = np.empty(len(first), np.int64)
            rank[np.lexsort([w[first] for w in reversed(words)])] = np.arange(len(first))
            return rank[of]
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), bool)
    for w in words:
        new[1:] |= w[order[1:]] != w[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _nearest_smaller(order: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each place in order the nearest one before it, not before ``least``, of a smaller value; else ``least`` - 1.
    Places in between have no smaller values, so a guess may jump to its own guess."""
    at = np.arange(len(order)) - 1
    open_ = np.flatnonzero(at >= least)
    while len(open_):
        open_ = open_[order[at[open_]] >= order[open_]]
        at[open_] = np.maximum(at[at[open_]], least[open_] - 1)
        open_ = open_[at[open_] >= least[open_]]
    return at


def earlier(body: np.ndarray, places: np.ndarray, ids: np.ndarray, length: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """Whether the ``length`` bytes at each place also start at another of the places that has a smaller id: whether the
    longest previous factor is so long. ``places`` rise. Places whose hash no other has are left out of the order."""
    out = np.zeros(len(places), bool)
    if hashes is None:
        hashes = grams(body, length)[places]
    order = np.argsort(hashes)
    same = np.zeros(len(places) + 1, bool)
    same[1:-1] = hashes[order[1:]] == hashes[order[:-1]]
    some = np.sort(order[same[1:] | same[:-1]])
    if not len(some):
        return out
    classes = suffix_classes(body, places[some], length, hashes[some])
    order = np.argsort(classes, kind="stable")
    sorted_, values = classes[order], ids[some][order]
    edges = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]]))
    sizes = np.diff(edges)
    first, last = np.repeat(edges[:-1], sizes), np.repeat(edges[1:] - 1, sizes)
    before = _nearest_smaller(values, first) >= first
    n = len(order)
    after = (_nearest_smaller(values[::-1], (n - 1 - last)[::-1]) >= (n - 1 - last)[::-1])[::-1]
    out[some[order]] = before | after
    return out


def runs(found: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true start and end, the end exclusive; a run stays within one part."""
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = part[1:] == part[:-1]
    starts = found & np.concatenate([[True], ~(found[:-1] & same)])
    stops = found & np.concatenate([~(found[1:] & same), [True]])
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1


def _first_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``t``, ``hash``: the anchors of each text, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.unique(_changes(anchors(x, length, gram))[0]) for x in bodies(batch.column("text"))]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            t = np.repeat(batch.column("t").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))], names=["t", "hash"])

    return texts.select("t", F.col("text").cast("binary")).mapInArrow(run, "t long, hash long")


FOUND = "t long, first long, at long, n long, key long, body binary"


class Stretches:
    """Stretches of texts, one after another in ``body``: for each the number of its bytes, its text, the text's id, its
    place in the text, and its key. All strings of ``length`` bytes inside a stretch count."""

    def __init__(self, length: int, body=(), size=(), t=(), first=(), at=(), key=()):
        self.length, self.body = length, np.asarray(body, np.uint8)
        self.size, self.t, self.first, self.at, self.key = (np.asarray(x, np.int64) for x in (size, t, first, at, key))
        self.counts = self.size - length + 1
        self.places = ranges(offsets_of(self.size)[:-1], self.counts)
        self.row = np.repeat(np.arange(len(self.size)), self.counts)
        self.inside = ranges(np.zeros(len(self.size), np.int64), self.counts)

    @classmethod
    def joined(cls, length: int, parts: list["Stretches"]) -> "Stretches":
        return cls(length, *(np.concatenate([getattr(p, c) for p in parts]) for c in ("body", "size", "t", "first", "at", "key"))) if parts else cls(length)

    def hashes(self) -> np.ndarray:
        return grams(self.body, self.length)[self.places].view(np.int64)

    def rows(self, starts: np.ndarray, stops: np.ndarray, key: np.ndarray | None = None, lone: np.ndarray | None = None) -> pa.RecordBatch:
        """The strings from each start to each stop as rows, with their bytes if they have a key. The places of ``lone``
        ones, which stand for all equal strings of their text, are written as negative numbers."""
        row, n = self.row[starts], stops - starts
        at = self.at[row] + self.inside[starts]
        if lone is not None:
            at = np.where(lone, -1 - at, at)
        if key is None:
            keys, bodies = pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.binary())
        else:
            sizes = n + self.length - 1
            whole = self.body[ranges(self.places[starts], sizes)]
            offsets = pa.py_buffer(offsets_of(sizes).astype(np.int32))
            keys, bodies = pa.array(key, pa.int64()), pa.Array.from_buffers(pa.binary(), len(row), [None, offsets, pa.py_buffer(whole)])
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (self.t[row], self.first[row], at, n)), keys, bodies], names=["t", "first", "at", "n", "key", "body"])

    @classmethod
    def read(cls, length: int, batch: pa.RecordBatch) -> "Stretches":
        body = batch.column("body")
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
        whole = np.frombuffer(body.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        return cls(length, whole, np.diff(offsets), *(batch.column(c).to_numpy() for c in ("t", "first", "at", "key")))


def _sent(candidates: DataFrame, length: int, gram: int) -> DataFrame:
    """Of texts with the anchors that others have too, ``hashes``, of which some are ``hot``: places with an earlier match
    among the texts of the task, without a key, and the stretches left, with a key and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        marks: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def done() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            array = Stretches(length, *(np.concatenate(x) for x in zip(*parts)))
            mine, hot = (np.concatenate(x) for x in zip(*marks))
            hashes = array.hashes()
            later = earlier(array.body, array.places, array.first[array.row], length, hashes)
            yield array.rows(*runs(later, array.row))
            # A new stretch starts where the anchor changes, and at each string of a hot anchor.
            change = np.concatenate([[True], (mine[1:] != mine[:-1]) | hot[1:] | (array.row[1:] != array.row[:-1])])
            starts, stops = runs(~later, np.cumsum(change))
            keys = np.where(hot[starts], hashes[starts], mine[starts])
            lone = np.flatnonzero(hot[starts])
            if len(lone):  # a text sends a string of a hot anchor once
                own = np.stack([array.t[array.row[starts[lone]]], keys[lone]])
                kept = np.ones(len(starts), bool)
                kept[lone] = False
                kept[lone[np.unique(own, axis=1, return_index=True)[1]]] = True
                starts, stops, keys = starts[kept], stops[kept], keys[kept]
            yield array.rows(starts, stops, keys, hot[starts])

        for batch in batches:
            columns = zip(batch.column("t").to_pylist(), batch.column("first").to_pylist(), bodies(batch.column("text")), batch.column("hashes"), batch.column("hot"))
            for t, first, body, listed, hot in columns:
                mine, long = _changes(anchors(body, length, gram))
                found = np.isin(mine, listed.values.to_numpy())
                whole = np.repeat(found, long)
                starts, stops = runs(whole, np.zeros(len(whole), np.int8))
                if len(starts):
                    sizes = stops - starts + length - 1
                    parts.append((body[ranges(starts, sizes)], sizes, np.full(len(starts), t), np.full(len(starts), first), starts, np.zeros(len(starts), np.int64)))
                    mine, long = mine[found], long[found]
                    marks.append((np.repeat(mine, long), np.repeat(np.isin(mine, hot.values.to_numpy()), long)))
                    held += int(sizes.sum())
                if held > ARRAY:
                    yield from done()
                    parts, marks, held = [], [], 0
        yield from done()

    return candidates.select("t", "first", F.col("text").cast("binary"), "hashes", "hot").mapInArrow(run, FOUND)


def _met(sent: DataFrame, length: int) -> DataFrame:
    """Places with an earlier match among all stretches of their key, without a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Stretches] = []
        held, carried = 0, 0

        def done() -> tuple[pa.RecordBatch, Stretches]:
            array = Stretches.joined(length, parts)
            hashes = array.hashes()
            gone = array.rows(*runs(earlier(array.body, array.places, array.first[array.row], length, hashes), array.row))
            # The last key may go on. Of it only the first copies do: rows come by id, so no later one can be earlier.
            last = np.flatnonzero(array.key[array.row] == array.key[-1])
            left = np.zeros(len(array.places), bool)
            left[last] = ~earlier(array.body, array.places[last], last, length, hashes[last])
            starts, stops = runs(left, array.row)
            return gone, Stretches.read(length, array.rows(starts, stops, array.key[array.row[starts]]))

        for batch in batches:
            if batch.num_rows:
                parts.append(Stretches.read(length, batch))
                held += len(parts[-1].body)
            if held > ARRAY + carried:
                gone, rest = done()
                yield gone
                parts, held, carried = [rest], len(rest.body), len(rest.body)
        if parts:
            yield done()[0]

    rows = sent.repartition("key").sortWithinPartitions("key", "first")
    return rows.mapInArrow(run, FOUND)


def _cut(texts: DataFrame, length: int, kept: str, digest: bool) -> DataFrame:
    """Removes what the strings at the places of ``gone`` cover."""

    def covered(body: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the removed runs start and stop."""
        lone = at < 0
        if lone.any():  # wherever the text holds them
            hashes = grams(body, length)
            more = np.flatnonzero(np.isin(hashes, hashes[-1 - at[lone]]))
            at, n = np.concatenate([at[~lone], more]), np.concatenate([n[~lone], np.ones(len(more), np.int64)])
        order = np.argsort(at)
        at, stop = at[order], np.maximum.accumulate((at + n)[order]) + length - 1
        new = np.concatenate([[True], at[1:] > stop[:-1]])
        return at[new], stop[np.concatenate([new[1:], [True]])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, left = [], [], [], []
            for body, gone in zip(bodies(batch.column("text")), batch.column("gone")):
                out, starts = body.tobytes(), ()
                if gone.is_valid:
                    starts, stops = covered(body, *(gone.values.field(c).to_numpy() for c in ("at", "n")))
                    out = b"".join(out[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(body)]))
                sizes.append(len(body))
                removed.append(len(body) - len(out))
                spans.append(len(starts))
                left.append(hashlib.sha256(out).hexdigest() if digest else out)
            kind = pa.string() if digest else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("first"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(left, kind)], names=["digest", "first", "n_bytes", "n_removed", "n_spans", kept])

    return texts.select("digest", "first", F.col("text").cast("binary"), "gone").mapInArrow(run, f"digest binary, first long, n_bytes long, n_removed long, n_spans long, {kept} {'string' if digest else 'binary'}")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, digest: bool = False) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes left; with ``digest`` instead
    ``kept_sha256``, the SHA-256 of that. ``gram`` is at most ``length``."""
    spark = df.sparkSession
    small_batches(spark)
    gram = min(gram, length)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("text"))
    distinct = rows.groupBy("digest").agg(F.min("id").alias("first"), F.first("text").alias("text"))
    texts = stored(distinct.withColumn("t", F.monotonically_increasing_id()), "texts")
    release(spark)
    met = stored(_first_anchors(texts, length, gram), "anchors")
    repeated = met.groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1")
    repeated = stored(repeated.select("hash", (F.col("texts") > hot).alias("hot")), "repeated")
    release(spark)
    listed = met.join(repeated, "hash").groupBy("t").agg(F.collect_list("hash").alias("hashes"), F.collect_list(F.when(F.col("hot"), F.col("hash"))).alias("hot"))
    listed = stored(listed, "candidates")
    drop(met, repeated)
    release(spark)
    sent = stored(_sent(texts.join(listed, "t"), length, gram), "stretches")
    drop(listed)
    release(spark)
    parts = []
    for i in range(LOTS):
        parts.append(stored(_met(sent.where("key IS NOT NULL").where(F.pmod(F.xxhash64("key"), F.lit(LOTS)) == i), length), "met"))
        release(spark)
    found = reduce(DataFrame.unionByName, [sent.where("key IS NULL"), *parts])
    gone = stored(found.groupBy("t").agg(F.collect_list(F.struct("at", "n")).alias("gone")), "gone")
    drop(sent, *parts)
    release(spark)
    kept = "kept_sha256" if digest else "kept"
    done = stored(_cut(texts.join(gone, "t", "left"), length, kept, digest), "cut")
    drop(texts, gone)
    release(spark)
    copy = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest()) if digest else F.lit(b"")
    whole = rows.select("key", "id", "digest").join(done, "digest")
    return whole.select(F.col("key").alias(key), "n_bytes", *(F.when(copy, all_).otherwise(F.col(c)).alias(c) for c, all_ in (("n_removed", F.col("n_bytes")), ("n_spans", F.lit(1).cast("long")), (kept, nothing))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), digest=True)


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
bases AS (SELECT doc_id, x, unnest(range(0, n, 500)) AS base FROM d WHERE n >= 50),
parts AS (SELECT doc_id, base, substr(x, 2 * base + 1, 1098) AS y FROM bases),
starts AS (SELECT doc_id, base, y, unnest(range(1, least(500, len(y) // 2 - 49) + 1)) AS i FROM parts),
wins AS (SELECT doc_id, base + i AS i, substr(y, 2 * i - 1, 100) AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS lo FROM wins GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM wins JOIN firsts USING (s) WHERE doc_id > lo),
sums AS (SELECT doc_id, CAST(sum(least(50, coalesce(after - i, 50))) AS BIGINT) AS n_removed, count(*) FILTER (before IS NULL OR i - before > 50) AS n_spans FROM gone GROUP BY doc_id),
edges AS (SELECT * FROM gone WHERE before IS NULL OR i - before > 50 OR after IS NULL OR after - i > 50),
pieces AS (SELECT doc_id, i, CASE WHEN before IS NULL OR i - before > 50 THEN substr(x, 2 * coalesce(before + 49, 0) + 1, 2 * (i - 1 - coalesce(before + 49, 0))) ELSE '' END AS piece FROM edges JOIN d USING (doc_id)),
tails AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS head, max(i) + 49 AS stop FROM pieces GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN stop IS NULL THEN x ELSE head || substr(x, 2 * stop + 1) END)) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN tails USING (doc_id)
"""
