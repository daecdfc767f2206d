"""Continuous ingestion: each micro-batch of bars is one upsert, so late restatements become revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.bars import SCHEMA
from ..sources.store import PriceStore


def bar_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of bars as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def ingest(stream: DataFrame, store: PriceStore, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Upserts a stream into the store. A batch that is run again after a failure changes nothing but its stamp."""

    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.write(batch, order=order).release()

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and type; what comes later than ``late`` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
