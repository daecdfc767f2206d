"""Features of a stream of prices: a ticker's prices are kept between batches, and what a late or restated price changes is
told anew.

The state of a ticker is a map from a year to its days, prices and stamps, and to the smoothed means at its end. Prices
that come in order touch the last year and read the days before that windows reach; a late one reads the years from its own
on, as its smoothed means go on into all later rows. So every batch costs by what it changes, and a replay in any batches
gives what ``features`` gives of the whole. The state lies in RocksDB, by the number of shuffle partitions that the first
start of a checkpoint had, and survives lost executors as its changes are written to the checkpoint with each batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.features import GAPS, LAGS, MOMENTUM, RANGE, RSI, VOLATILITY, names

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = date(1970, 1, 1)


def feature_schema(lags: int = LAGS) -> T.StructType:
    return T.StructType([T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("price", *names(lags)))])


def last_rows(values: np.ndarray, rows: int, reduce) -> np.ndarray:
    """``reduce`` over the last rows of each row; not a number until as many values are there."""
    out = np.full(len(values), np.nan)
    if len(values) >= rows:
        out[rows - 1 :] = reduce(np.lib.stride_tricks.sliding_window_view(values, rows), axis=1)
    return out


def back(values: np.ndarray, rows: int) -> np.ndarray:
    """The values of so many rows before."""
    return np.concatenate([np.full(min(rows, len(values)), np.nan), values[: max(0, len(values) - rows)]])


def windows(prices: np.ndarray, lags: int) -> dict[str, np.ndarray]:
    """The features of one ticker that look back a fixed number of rows. What is undefined is not a number."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        rise = lambda rows: np.where(back(prices, rows) == 0, np.nan, prices / back(prices, rows) - 1)
        ret = rise(1)
        out = {f"ret_lag_{k}": back(ret, k - 1) for k in range(1, lags + 1)}
        out |= {f"vol_{w}": last_rows(ret, w, lambda x, axis: np.std(x, axis=axis, ddof=1)) for w in VOLATILITY}
        out |= {f"mom_{w}": rise(w) for w in MOMENTUM}
        out |= {f"ma_gap_{w}": prices / last_rows(prices, w, np.mean) - 1 for w in GAPS}
        low, high = last_rows(prices, RANGE, np.min), last_rows(prices, RANGE, np.max)
        out["range_position"] = (prices - low) / (high - low)
    return {n: np.where(np.isfinite(v), v, np.nan) for n, v in out.items()}


def smoothed(prices: np.ndarray, before: float | None, gain: float, loss: float) -> np.ndarray:
    """Exponentially weighted means of rises and falls, a row for each price, gone on from those of the price before."""
    out = np.full((len(prices), 2), np.nan)
    for i, price in enumerate(prices.tolist()):
        if before is not None:
            up, down = max(price - before, 0.0), max(before - price, 0.0)
            gain, loss = (up, down) if gain != gain else (gain + (up - gain) / RSI, loss + (down - loss) / RSI)
        before = price
        out[i] = gain, loss
    return out


class LiveFeatures(StatefulProcessor):
    """One ticker's rows of a batch become the features of all rows that they change."""

    def __init__(self, lags: int):
        self.lags = lags
        self.reach = max(*VOLATILITY, *MOMENTUM, *GAPS, RANGE, lags + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.years = handle.getMapState("years", "year int", "days array<int>, prices array<double>, stamps array<bigint>, gain double, loss double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat(list(rows)).sort_values(["day", "stamp", "price"]).drop_duplicates("day", keep="last")
        known = sorted(y for (y,) in self.years.keys())
        changed = self.merged(came, set(known))
        if not changed:
            return
        first = min(changed)
        start, base = (EPOCH + timedelta(days=first)).year, []
        years = sorted({*known, *((EPOCH + timedelta(days=d)).year for d in changed)})
        earlier, context = [y for y in years if y < start], 0
        for year in reversed(earlier):  # as far back as windows reach
            base.insert(0, self.years.getValue((year,)))
            context += len(base[0][0])
            if context >= self.reach:
                break
        gain, loss = (base[-1][3], base[-1][4]) if base else (np.nan, np.nan)
        before = base[-1][1][-1] if base else None
        days, prices = [d for b in base for d in b[0]], [p for b in base for p in b[1]]
        means = [np.full((len(prices), 2), np.nan)]
        for year in years[len(earlier) :]:
            at, of, stamps, *_ = self.years.getValue((year,))
            means.append(smoothed(np.array(of, float), before, gain, loss))
            (gain, loss), before = means[-1][-1].tolist(), of[-1]
            self.years.updateValue((year,), (list(at), list(of), list(stamps), gain, loss))
            days += at
            prices += of
        day, values, mean = np.array(days), np.array(prices, float), np.concatenate(means)
        told = np.flatnonzero(day >= first)
        told_from = max(0, told[0] - self.reach)
        out = {n: v[told - told_from] for n, v in windows(values[told_from:], self.lags).items()}
        with np.errstate(divide="ignore", invalid="ignore"):
            strength = mean[told, 0] / mean[told, 1]
        out[f"rsi_{RSI}"] = np.where(mean[told, 1] > 0, 1 - 1 / (1 + strength), 0.5)
        dates = pd.Series(pd.to_datetime(day[told], unit="D", origin="unix"))
        out |= {"date": dates.dt.date, "ticker": key[0], "price": values[told], "weekday": dates.dt.weekday.astype(float), "month": dates.dt.month.astype(float)}
        yield pd.DataFrame(out)[feature_schema(self.lags).names].replace({np.nan: None})

    def merged(self, came: pd.DataFrame, known: set[int]) -> list[int]:
        """Puts prices into the state and returns the days that are new or have another price. A price with an earlier stamp
        than the one that is known changes nothing; of equal stamps the later batch counts."""
        changed = []
        for year, part in came.groupby(pd.to_datetime(came["day"], unit="D", origin="unix").dt.year):
            year = int(year)
            old = self.years.getValue((year,)) if year in known else ((), (), (), float("nan"), float("nan"))
            held = {d: (p, s) for d, p, s in zip(*old[:3])}
            touched = False
            for day, price, stamp in zip(part["day"].tolist(), part["price"].tolist(), part["stamp"].tolist()):
                now = held.get(day)
                if now is None or stamp >= now[1]:
                    touched = touched or now != (price, stamp)
                    if now is None or now[0] != price:
                        changed.append(day)
                    held[day] = (price, stamp)
            if touched:
                days = sorted(held)
                self.years.updateValue((year,), (days, [held[d][0] for d in days], [held[d][1] for d in days], old[3], old[4]))
        return changed

    def close(self) -> None:
        pass


def live_features(prices: DataFrame, order: Column | None = None, lags: int = LAGS) -> DataFrame:
    """A stream of ``features`` rows for a stream of ``date, ticker, price``; a row replaces what was told of its date and
    ticker before.

    ``order`` is a timestamp or whole number that tells which price of a date is newest, whatever batch it comes in; without
    it the later batch counts, and in a batch the higher price. Rows without a date, a ticker or a finite price are left
    out; other columns are too. A stream without rows gives none.
    """
    stamp = F.lit(0).cast("long") if order is None else order
    if order is not None and dict(prices.select(order.alias("o")).dtypes)["o"].startswith("timestamp"):
        stamp = F.unix_micros(order.cast("timestamp"))
    price = F.col("price").cast("double")
    rows = prices.where(F.col("date").isNotNull() & F.col("ticker").isNotNull() & (F.abs(price) < float("inf")))
    rows = rows.select("ticker", F.unix_date(F.col("date").cast("date")).alias("day"), price.alias("price"), F.coalesce(stamp.cast("long"), F.lit(-(1 << 63)).cast("long")).alias("stamp"))
    return rows.groupBy("ticker").transformWithStateInPandas(LiveFeatures(lags), feature_schema(lags), "Update", "None")


def start(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each batch of ``live_features`` to a folder of its own, so that one that runs again after a failure replaces
    itself. The session's state store is as before when this returns."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def latest(spark: SparkSession, path: str, lags: int = LAGS) -> DataFrame:
    """What the batches of ``start`` told last of each date and ticker."""
    schema = feature_schema(lags)
    rows = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(path)
    told = rows.groupBy("date", "ticker").agg(F.max_by(F.struct(*schema.names[2:]), "batch").alias("told"))
    return told.select("date", "ticker", "told.*")
