"""Quality classifier: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates.

A text's words and punctuation runs, in lower case, and its pairs of neighbours are hashed to ``2 ** bits`` weights; a
pair of equal neighbours counts as one n-gram whatever the word. Counts are scaled to length 1, so a score is the
logistic of a sparse dot product. The labelled rows of a bounded sample are dealt to shards; each shard makes FTRL
updates over its own rows, and Spark averages the weights. The model has a fixed number of weights, whatever the corpus.

Rows whose label is null or neither 0 nor 1, or without an id, aren't learnt from; an id with several labels counts once,
with the largest, and one with several texts with the least of them, so no id weighs more than another and no shard holds
more than its rows. Null and empty texts have no n-grams and score the base rate; texts are read whole. Without any label
the score is 0.5. Equal texts have equal scores. Rows, repeated ones too, come out one for one with all their columns, of
which one named like the score is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import once, small_batches, table

WORDS = re.compile(r"\w+|[^\w\s]+")
REPEATED = np.uint64(0x5BD1E9955BD1E995)
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    #: Labelled rows that are learnt from, at most; the ones with the least hash of their id.
    sample: int = 20_000
    #: Rows that one shard learns from.
    shard_rows: int = 5_000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 1e-3


class Features:
    """Hashed n-grams of texts. Hashes of words met before are kept, a bounded number of them."""

    def __init__(self, bits: int, keep: int = 200_000):
        self.shift, self.keep, self.known = np.uint64(64 - bits), keep, {}

    def _words(self, text: str) -> np.ndarray:
        known, words = self.known, WORDS.findall(text.lower())
        hashes = list(map(known.get, words))
        if None in hashes:
            if len(known) > self.keep:
                known.clear()
            hashes = [known.setdefault(w, zlib.crc32(w.encode("utf-8", "surrogatepass"))) if h is None else h for w, h in zip(words, hashes)]
        return np.array(hashes, np.uint64)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The places of a text's n-grams among the weights, and their values."""
        one = self._words(text or "")
        if not len(one):
            return np.zeros(0, np.int64), np.zeros(0)
        left, right = one[:-1], one[1:]
        two = np.where(left == right, REPEATED, left * MIX[0] + right * MIX[1])
        place = (np.concatenate([one, two]) * MIX[2]) >> self.shift
        places, counts = np.unique(place.astype(np.int64), return_counts=True)
        return places, counts / np.sqrt(np.dot(counts, counts))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights, the last one the bias, after ``epochs`` passes over the rows, each in an order of its own."""
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(0)

    def weights(at):
        pull = z[at]
        return np.where(np.abs(pull) <= s.l1, 0.0, -(pull - np.sign(pull) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    rows = [(np.append(places, size - 1), np.append(values, 1.0), y) for places, values, y in rows]
    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = weights(at)
            g = (logistic(w @ x) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    return weights(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """The averaged weights; ``labels`` holds the rows that may be learnt from."""
    s = settings
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(F.max(label).cast("int").alias("y"))
    # The bound on the sample is what makes it small enough to broadcast.
    sample = usable.orderBy(F.xxhash64("label_key"), "label_key").limit(s.sample)
    chosen = sample.select("label_key", "y").collect()
    if not chosen:
        return np.zeros((1 << s.bits) + 1)
    shards = -(-len(chosen) // s.shard_rows)
    kinds = T.StructType([usable.schema["label_key"], T.StructField("y", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    picked = docs.sparkSession.createDataFrame([(r.label_key, r.y, i % shards) for i, r in enumerate(chosen)], kinds)
    rows = docs.select(F.col(key).alias("label_key"), F.col(text).alias("text")).join(F.broadcast(picked), "label_key")
    rows = rows.groupBy("label_key", "y", "shard").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [*batches]
        for _, part in pd.concat(held).groupby("shard") if held else ():
            part = part.sort_values(["label_key", "y"], kind="stable")
            features = Features(s.bits)
            w = ftrl([(*features(t), y) for t, y in zip(part["text"], part["y"])], s)
            at = np.flatnonzero(w)
            yield pd.DataFrame({"place": at, "weight": w[at]})

    # A task for each shard: hashed, two of so few numbers often meet in one.
    learnt = rows.repartitionById(shards, "shard").mapInPandas(learn, "place long, weight double").groupBy("place").agg(F.sum("weight").alias("weight")).toPandas()
    out = np.zeros((1 << s.bits) + 1)
    out[learnt["place"].to_numpy()] = learnt["weight"].to_numpy() / shards
    return out


def score(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score", drop_text: bool = False) -> DataFrame:
    """``df`` with ``out``, from 0 to 1; a column of that name is replaced."""
    spark = df.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(weights)
    call = uuid.uuid4().hex
    kept = [c for c in df.columns if c != out and not (drop_text and c == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        features = once(call, lambda: Features((len(w) - 1).bit_length() - 1))
        for batch in batches:
            dots = np.empty(batch.num_rows)
            for i, value in enumerate(batch.column(text)):
                places, values = features(value.as_py())
                dots[i] = w[places] @ values + w[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(logistic(dots))], names=[*kept, out])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.DoubleType())]))


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(4)) == 2


THRESHOLD = 0.7


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs, weights, drop_text=True)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
