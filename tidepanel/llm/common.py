"""Helpers that the text operators share: reading tables, the shared folder, Arrow batches."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shared import drop, shared_dir, stored

__all__ = ["drop", "fresh_name", "list_array", "numbered", "offsets_of", "once", "ranges", "release", "shared_dir", "small", "small_batches", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it as long as ``df`` has such a column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str, *more: Column) -> DataFrame:
    """``df`` stored with a number of its own for each row, whatever its columns hold, and with the columns ``more``."""
    return stored(df.select("*", *more, F.monotonically_increasing_id().alias(name)), "rows")


#: Bytes that a table to be joined may take to be broadcast.
SMALL = 32 << 20


def small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """A stored table, marked to be broadcast if its rows take no more than ``SMALL`` bytes together; else Spark deals out
    both sides of a join."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= SMALL else df


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Bounds what a Python worker holds of long texts at once; the settings count when the plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ..., start + length - 1, for each pair in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished jobs, which Spark keeps until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_KEPT: dict[str, object] = {}


def once(call: str, make):
    """What a Python worker has made for one call of an operator, kept for its next task. A worker keeps that of one call
    only: it serves all stages of an application, and their memory would add up."""
    if call not in _KEPT:
        _KEPT.clear()
        _KEPT[call] = make()
    return _KEPT[call]
