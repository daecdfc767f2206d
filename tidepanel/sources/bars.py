"""The bar relation: its schema, and its derivation from order lines.

Prices per day and ticker come from whatever the lines of a part type sold for: the volume-weighted unit price is the
adjusted close. Lines have no unique key of their own, so first and last are told by the whole line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

VALUES = ("open", "high", "low", "close", "adj_close", "volume")
SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in VALUES[:5]),
    T.StructField("volume", T.LongType()), T.StructField("ingested_at", T.TimestampNTZType()),
])


def bars(spark: SparkSession, sf_dir: str, ticker: str = "p_type") -> DataFrame:
    """A row for each ticker and day: ``date, ticker, open, high, low, close, adj_close, volume``."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col(ticker).alias("ticker"))
    unit = F.round(F.try_divide("l_extendedprice", "l_quantity"), 6)
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = lines.join(parts, "l_partkey").select(F.to_date("l_shipdate").alias("date"), "ticker", unit.alias("unit"), place.alias("place"), "l_extendedprice", "l_quantity")
    return rows.groupBy("date", "ticker").agg(
        F.min_by("unit", "place").alias("open"),
        F.max("unit").alias("high"),
        F.min("unit").alias("low"),
        F.max_by("unit", "place").alias("close"),
        F.round(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")), 6).alias("adj_close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


def prices(frame: DataFrame) -> DataFrame:
    """The long price frame, ``date, ticker, price``, without nulls."""
    return frame.select("date", "ticker", F.col("adj_close").alias("price")).dropna(subset=["price"])


#: DuckDB SQL for the same relations, to stand in front of a query.
ORACLE = """
WITH sold AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_type AS ticker, round(l_extendedprice / l_quantity, 6) AS unit, l_extendedprice, l_quantity,
    l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey
), bars AS (
  SELECT date, ticker,
    first(unit ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open, max(unit) AS high, min(unit) AS low,
    last(unit ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close,
    round(sum(l_extendedprice) / sum(l_quantity), 6) AS adj_close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM sold GROUP BY date, ticker
), prices AS (SELECT date, ticker, adj_close AS price FROM bars WHERE adj_close IS NOT NULL)
"""
