"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` deals the training texts into blocks of whole documents and stores, for each block, the postings of all
its terms: the positions of a term in the block, ascending, delta-coded. A block's documents follow each other with a gap
between them, so that a list of positions never runs over from one to the next. The index serves any test items.

``search`` turns the items into a table of distinct windows, counts their terms over the whole index, and joins each
window to the blocks that hold its rarest term; only there the lists of its terms are intersected, each moved by its
term's offset, from the rarest in the block to the most frequent. With ``slop`` a term may stand that many places off,
which gives proximity matches; with 0 matches are exact phrases.

Blocks are bounded in bytes and rows (a longer document is a block of its own) and all work on a block is one small task,
so a passage that a third of the documents share costs each of them its own postings and no more. Neither texts nor items
pass through the driver, and nothing is broadcast but what Spark finds small enough itself.

Words are lower-cased A-Z, runs of ASCII letters, digits and non-ASCII characters. Null and empty texts have no words
and are not contaminated; items without words have no windows. Items that repeat, or share an id, count as one id; the
windows of items without an id are found, but nothing is listed for them. Documents come out one for one, repeated ones
and those without an id too, with their key; texts of any length are read whole; an empty table gives no rows, and one
without items no hits. Columns besides key and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import drop, ranges, small_batches, stored, table

WINDOW = 10
#: Bytes of text, and rows, whose postings are one block.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 65_536

#: A-Z to a-z, and every other ASCII character that is no letter or digit to a space.
_WORDY = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDY).split()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint32).astype(np.int64))


def binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    """Slices of ``data``, one after the other, as an Arrow column."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])


INDEX = T.StructType([
    T.StructField("block", T.StringType()), T.StructField("term", T.BinaryType()), T.StructField("postings", T.BinaryType()),
    T.StructField("row", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType()),
])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", gap: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The stored index: a row for each term of a block, with its postings, and a row for each document of a block, with
    its key, its number in the block, the position of its first word and its number of words."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*INDEX.fields, T.StructField("key", docs.schema[key].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = 0, TaskContext.get().partitionId()
        key_type = None

        def block(rows: list, texts: list) -> Iterator[pa.RecordBatch]:
            nonlocal number
            name = f"{part}-{number}"
            number += 1
            known: dict[bytes, int] = {}
            ids, counts = [], np.empty(len(texts), np.int64)
            for i, value in enumerate(texts):
                found = words(value)
                counts[i] = len(found)
                ids.append(np.array([known.setdefault(w, len(known)) for w in found], np.int32))
            starts = np.cumsum(counts + gap) - (counts + gap)
            term = np.concatenate(ids)
            order = np.argsort(term, kind="stable")
            at = ranges(starts, counts)[order]
            ends = np.cumsum(np.bincount(term, minlength=len(known)))
            steps = np.diff(at, prepend=0)
            steps[ends[:-1]] = at[ends[:-1]]  # a list begins with its first position
            n = len(known)
            if n:
                terms = pa.array(list(known), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), terms, binaries(steps.astype(np.uint32).tobytes(), ends * 4), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, key_type)], names=schema.names)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(starts), pa.array(counts), pa.array(rows, key_type)], names=schema.names)

        rows, texts, size = [], [], 0
        for batch in batches:
            key_type = batch.schema.field(key).type
            for k, value in zip(batch.column(key).to_pylist(), batch.column(text)):
                value = value.as_py()
                rows.append(k)
                texts.append(value)
                size += len(value or "")
                if size >= block_bytes or len(rows) == BLOCK_ROWS:
                    yield from block(rows, texts)
                    rows, texts, size = [], [], 0
        if texts:
            yield from block(rows, texts)

    return stored(docs.select(F.col(key), F.col(text)).mapInArrow(run, schema), "postings")


def windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``window``, a digest, ``words`` and ``item``, the id as a string: a row for each distinct window of each item. An
    item of fewer words than a window is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(batch.column("item").to_pylist(), batch.column("text")):
                w = words(value.as_py())
                found = dict.fromkeys(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1) if w else 0))
                digests = [hashlib.sha256(b" ".join(x)).digest() for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(map(list, found), pa.list_(pa.binary())), pa.array([item] * len(digests), pa.string())], names=["window", "words", "item"])

    some = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    return some.mapInArrow(run, "window binary, words array<binary>, item string").distinct()


def near(lists: list[tuple[int, np.ndarray]], slop: int) -> np.ndarray:
    """Starts at which each list, moved by its offset, has a position no more than ``slop`` off; rarest list first."""
    offset, first = lists[0]
    starts = first - offset
    if slop:
        starts = np.unique((starts[:, None] + np.arange(-slop, slop + 1)).ravel())
    for offset, at in lists if slop else lists[1:]:
        if not len(starts):
            break
        i = np.searchsorted(at, starts + offset - slop)
        ok = i < len(at)
        ok[ok] = at[i[ok]] <= starts[ok] + offset + slop
        starts = starts[ok]
    return starts


def search(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """A row for each document of the index: ``key``, ``n_words``, ``hits``, the ranges of words inside any match, from 0,
    end exclusive, in order and apart, and ``items``, the sorted ids of the items that match. Proximity matches cover the
    places of the phrase itself. ``phrases`` is a table as ``windows`` makes it."""
    phrases = stored(phrases, "windows")
    distinct = phrases.groupBy("window").agg(F.any_value("words").alias("words"))
    placed = distinct.select("window", F.explode("words").alias("term"))
    terms = placed.select("term").distinct()
    # The part of the index that these items can meet.
    lists = stored(index.where("term IS NOT NULL").select("block", "term", "postings").join(terms, "term", "left_semi"), "lists")
    counts = lists.groupBy("term").agg(F.sum(F.octet_length("postings")).alias("bytes"))
    # A window with a term that the corpus lacks occurs nowhere.
    rarest = placed.join(counts, "term", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("bytes", F.lit(0)).alias("bytes"), "term")).alias("rarest"))
    rarest = rarest.where("rarest.bytes > 0").select("window", F.col("rarest.term").alias("term"))
    tried = lists.select(F.col("block").alias("within"), "term").join(rarest, "term").join(distinct, "window").select("within", "window", "words")
    documents = index.where("row IS NOT NULL").select("block", F.lit(None).cast("binary").alias("term"), F.lit(None).cast("binary").alias("postings"), "row", "start", "n_words", "key")
    nothing = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in ("row", "start", "n_words", "key")]
    blocks = lists.select("block", "term", "postings", *nothing).unionByName(documents)
    out = T.StructType([T.StructField("block", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("key", index.schema["key"].dataType), T.StructField("n_words", T.LongType())])
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = out.add("hits", T.ArrayType(span)).add("windows", T.ArrayType(T.BinaryType()))

    def match(block: pa.Table, tried: pa.Table) -> pa.Table:
        some = block.column("term").is_valid()
        docs = block.filter(block.column("term").is_null()).sort_by("row")
        own = block.filter(some)
        at_term = dict(zip(own.column("term").to_pylist(), own.column("postings")))
        starts, counts = (docs.column(c).to_numpy() for c in ("start", "n_words"))
        found: dict[int, list[tuple[int, int]]] = {}
        met: dict[int, list[bytes]] = {}
        read: dict[bytes, np.ndarray] = {}
        for window, phrase in zip(tried.column("window").to_pylist(), tried.column("words").to_pylist()):
            if not all(t in at_term for t in phrase):
                continue
            for t in phrase:
                if t not in read:
                    read[t] = unpacked(at_term[t].as_py())
            at = near(sorted(((i, read[t]) for i, t in enumerate(phrase)), key=lambda x: (len(x[1]), x[0])), slop)
            if not len(at):
                continue
            row = np.searchsorted(starts, at, side="right") - 1
            ends = np.minimum(at + len(phrase), starts[row] + counts[row])
            for r, a, b in zip(row.tolist(), (np.maximum(at, starts[row]) - starts[row]).tolist(), (ends - starts[row]).tolist()):
                if a < b:
                    found.setdefault(r, []).append((a, b))
                    if window not in met.setdefault(r, [])[-1:]:
                        met[r].append(window)
        n = docs.num_rows
        hits = [[{"start": a, "end": b} for a, b in merged(found.get(r, []))] for r in range(n)]
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([docs.column("block"), docs.column("row"), docs.column("key"), docs.column("n_words"), pa.array(hits, kinds), pa.array([met.get(r, []) for r in range(n)], pa.list_(pa.binary()))], names=out.names)

    matched = stored(blocks.groupBy("block").cogroup(tried.groupBy("within")).applyInArrow(match, out), "matched")
    drop(lists)
    items = matched.select("block", "row", F.explode("windows").alias("window")).join(phrases.select("window", "item"), "window")
    items = items.groupBy("block", "row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return matched.join(items, ["block", "row"], "left").select("key", "n_words", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = WINDOW, slop: int = 0) -> DataFrame:
    """Index and search in one: ``key``, ``n_words``, ``hits`` and ``items`` of each document."""
    index = build_index(docs, key, text, gap=size + slop)
    out = search(index, windows(items, item_key, item_text, size), slop)
    drop(index)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
