"""Substring dedup by level-wise doubling.

Windows of words that occur in two documents at one length are the only candidates at twice that length, up to the
length that counts: of 13 words, after 7. A window of the first length is looked at only where its hash is the least
among those inside a window of the second length; equal windows choose alike, so a second-length window is a candidate
just where the one it chose is repeated. Each level is a table in the shared folder: hashes with the text they are in,
aggregated before they are shuffled, joined back to the texts as lists of hashes. Levels end when the last length is done
or no candidate is left.

A word is removed if a window that covers it, and is repeated, starts in a document with a smaller id. All levels work on
distinct texts, told apart by SHA-256, each with the least id that it has: what is removed of the row with that id depends
on the ids of other texts, and rows of the same text with larger ids lose every word that is in a window. So a list of
hashes is never longer than one text, however many rows share it, its id, or lack an id. Windows count as equal by 96
bits of hash.

Words are runs of anything but ASCII white space. Null texts have no words; texts shorter than a window keep all; texts
of any length are read whole. Rows without an id come after all others and not one after another. Rows that share an id
don't remove each other's words. Each row comes out once; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import drop, release, small_batches, stored, table

WINDOW = 13
LAST = (1 << 63) - 1
FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Hashes:
    """Hashes of words; those met before are kept, a bounded number of them."""

    def __init__(self, keep: int = 300_000):
        self.keep, self.known = keep, {}

    def __call__(self, found: list[bytes]) -> np.ndarray:
        known = self.known
        out = list(map(known.get, found))
        if None in out:
            if len(known) > self.keep:
                known.clear()
            digest = xxhash.xxh3_64_intdigest
            out = [known.setdefault(w, digest(w)) if h is None else h for w, h in zip(found, out)]
        return np.array(out, np.uint64)


def windows(word: np.ndarray, length: int, factor: np.uint64 = FACTORS[0]) -> np.ndarray:
    """The hash of each window of ``length`` words."""
    n = len(word) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out *= factor
        out += word[i : i + n]
    out ^= out >> np.uint64(32)
    out *= factor
    return out ^ (out >> np.uint64(29))


def chosen(word: np.ndarray, length: int, longer: int) -> np.ndarray:
    """For each window of ``longer`` words the least hash of the windows of ``length`` words inside it."""
    hashes = windows(word, length)
    n = len(word) - longer + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = hashes[:n].copy()
    for i in range(1, longer - length + 1):
        np.minimum(out, hashes[i : i + n], out=out)
    return out.view(np.int64)


def lengths(window: int) -> list[int]:
    """``window`` halved, rounded up, down to 7 words or fewer; from the shortest."""
    out = [window]
    while out[0] > 7:
        out.insert(0, (out[0] + 1) // 2)
    return out if len(out) > 1 else [max(1, (window + 1) // 2), window]


def _first_level(texts: DataFrame, short: int, longer: int) -> DataFrame:
    """``t``, ``first``, ``hash``: the chosen windows of each text, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            lists = [np.unique(chosen(hashes(words(x.as_py())), short, longer)) for x in batch.column("text")]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            t, first = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("t", "first"))
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(first), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))], names=["t", "first", "hash"])

    return texts.select("t", "first", "text").mapInArrow(run, "t long, first long, hash long")


def _next_level(candidates: DataFrame, shorter: int, length: int, sampled: bool) -> DataFrame:
    """``t``, ``first``, ``hash``, ``check``: windows of ``length`` words, once a text, whose shorter windows are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], []]
            counts = []
            for text, listed in zip(batch.column("text"), batch.column("hashes")):
                word = hashes(words(text.as_py()))
                listed = listed.values.to_numpy()
                if sampled:
                    ok = np.isin(chosen(word, shorter, length), listed)
                else:
                    known = np.isin(windows(word, shorter).view(np.int64), listed)
                    n = max(0, len(word) - length + 1)
                    ok = known[:n] & known[length - shorter : length - shorter + n]
                full, first = np.unique(windows(word, length)[ok].view(np.int64), return_index=True)
                check = windows(word, length, FACTORS[1])[ok][first]
                out[0].append(full)
                out[1].append((check >> np.uint64(32)).astype(np.uint32).view(np.int32))
                counts.append(len(full))
            t, first = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("t", "first"))
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(first), pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1]))], names=["t", "first", "hash", "check"])

    return candidates.select("t", "first", "text", "hashes").mapInArrow(run, "t long, first long, hash long, check int")


def _cut(texts: DataFrame, window: int, kept: str, digest: bool) -> DataFrame:
    """Removes what the windows listed in ``hashes`` cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            total, gone, left = [], [], []
            for text, listed in zip(batch.column("text"), batch.column("hashes")):
                found = words(text.as_py())
                n = len(found)
                removed = 0
                if listed.is_valid and n >= window:
                    hit = np.isin(windows(hashes(found), window).view(np.int64), listed.values.to_numpy())
                    edge = np.zeros(n + 1, np.int32)
                    edge[: len(hit)] += hit
                    edge[window : window + len(hit)] -= hit
                    keep = np.cumsum(edge[:n]) == 0
                    found = [found[i] for i in np.flatnonzero(keep).tolist()]
                    removed = n - len(found)
                total.append(n)
                gone.append(removed)
                body = b" ".join(found)
                left.append(hashlib.sha256(body).hexdigest() if digest else body.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("first"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["digest", "first", "n_words", "n_removed", kept])

    return texts.select("digest", "first", "text", "hashes").mapInArrow(run, f"digest binary, first long, n_words long, n_removed long, {kept} string")


def _repeated(met: DataFrame, by: list[str]) -> DataFrame:
    """The windows that texts with different least ids hold, with the least id."""
    return met.groupBy(*by).agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo < hi").select(*by, "lo")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept``, the words left, joined by one space; with ``digest`` instead
    ``kept_sha256``, the SHA-256 of that."""
    spark = df.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("text"))
    distinct = rows.groupBy("digest").agg(F.min("id").alias("first"), F.first("text").alias("text"))
    texts = stored(distinct.withColumn("t", F.monotonically_increasing_id()), "texts")
    release(spark)
    plan = lengths(window)
    met, by = stored(_first_level(texts, plan[0], plan[1]), "windows"), ["hash"]
    for shorter, length in zip(plan, plan[1:]):
        repeated = stored(_repeated(met, by).select(*by), "repeated")
        release(spark)
        listed = stored(met.join(repeated, by).groupBy("t").agg(F.collect_list("hash").alias("hashes")), "candidates")
        drop(met, repeated)
        release(spark)
        met, by = stored(_next_level(texts.join(listed, "t"), shorter, length, shorter == plan[0]), "windows"), ["hash", "check"]
        drop(listed)
        release(spark)
    repeated = stored(_repeated(met, by), "repeated")
    release(spark)
    removed = stored(met.join(repeated, by).where("first > lo").groupBy("t").agg(F.collect_list("hash").alias("hashes")), "removed")
    drop(met, repeated)
    release(spark)
    kept = "kept_sha256" if digest else "kept"
    done = stored(_cut(texts.join(removed, "t", "left"), window, kept, digest), "cut")
    drop(texts, removed)
    release(spark)
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)
    nothing = F.lit(hashlib.sha256(b"").hexdigest() if digest else "")
    whole = rows.select("key", "id", "digest").join(done, "digest")
    return whole.select(F.col("key").alias(key), "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, nothing).otherwise(F.col(kept)).alias(kept))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), digest=True)
