"""Windowed features of a whole universe in one plan: every column over the one window of a ticker's dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.frames import finite
from .windows import by_date

# Window lengths and the decay of the relative strength index.
VOLATILITY, MOMENTUM, GAPS, RANGE, RSI, LAGS = (5, 21, 63), (5, 21, 63), (21, 63), 21, 14, 10

#: Rows of a ticker that are smoothed in one group.
BLOCK = 256


def names(lags: int = LAGS) -> list[str]:
    return [
        *(f"ret_lag_{k}" for k in range(1, lags + 1)), *(f"vol_{w}" for w in VOLATILITY), *(f"mom_{w}" for w in MOMENTUM),
        *(f"ma_gap_{w}" for w in GAPS), "range_position", f"rsi_{RSI}", "weekday", "month",
    ]


def over_full(value: Column, aggregate: Column, rows: int) -> Column:
    """An aggregate over the last rows, null until as many values are there."""
    frame = by_date().rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) >= rows, aggregate.over(frame))


def smoothed(frame: DataFrame, alpha: float = 1 / RSI, block: int = BLOCK) -> DataFrame:
    """Adds ``gain`` and ``loss``, exponentially weighted means of the rises and falls in ``delta``.

    A mean goes on from row to row as factor * mean + addend, and so it does from block to block of a ticker's dates: the
    rows of a block come down to one factor and addend, a window composes those of the blocks before, and each block is
    gone through again from the value that reaches it. No group holds more than a block. A row without a move keeps the
    mean, which weighs less the longer that goes on; before the first move there is none.
    """
    moved = F.when(F.col("delta").isNotNull(), F.col("seq_"))
    before = F.last(moved, ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, -1))
    weight = F.pow(F.lit(1 - alpha), F.col("seq_") - F.col("before_"))
    first, still = F.col("before_").isNull(), F.col("delta").isNull()
    share = F.when(first, 1.0).otherwise(alpha / (weight + alpha))
    rows = frame.withColumn("seq_", F.row_number().over(by_date()) - 1).withColumn("before_", before)
    rows = rows.select(
        "ticker", F.floor(F.col("seq_") / block).alias("block_"), "seq_", F.struct(*frame.columns).alias("row"), (first & still).alias("none"),
        F.when(still, 1.0).when(first, 0.0).otherwise(weight / (weight + alpha)).alias("f"),
        *(F.when(still, 0.0).otherwise(share * F.greatest(move, F.lit(0.0))).alias(n) for n, move in (("up", F.col("delta")), ("down", -F.col("delta")))),
    )
    blocks = rows.groupBy("ticker", "block_").agg(F.sort_array(F.collect_list(F.struct("seq_", "row", "none", "f", "up", "down"))).alias("rows"))
    pair = lambda f, up, down: F.struct(f.alias("f"), up.alias("up"), down.alias("down"))
    after = lambda acc, x: pair(acc["f"] * x["f"], acc["up"] * x["f"] + x["up"], acc["down"] * x["f"] + x["down"])
    nothing = pair(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    earlier = F.collect_list("all").over(Window.partitionBy("ticker").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("all", F.aggregate("rows", nothing, after)).withColumn("start", F.aggregate(earlier, nothing, after)).drop("all")
    told = "array<struct<gain:double,loss:double>>"

    def replayed(acc: Column, x: Column) -> Column:
        now = after(acc["at"], x)
        mean = F.struct(F.when(~x["none"], now["up"]).alias("gain"), F.when(~x["none"], now["down"]).alias("loss"))
        return F.struct(now.alias("at"), F.concat(acc["out"], F.array(mean).cast(told)).alias("out"))

    means = F.aggregate("rows", F.struct(F.col("start").alias("at"), F.array().cast(told).alias("out")), replayed)["out"]
    out = blocks.select(F.explode(F.arrays_zip("rows", means.alias("mean"))).alias("z"))
    return out.select("z.rows.row.*", "z.mean.gain", "z.mean.loss")


def relative_strength() -> Column:
    """From ``gain`` and ``loss``; 0.5 where it is undefined."""
    strength = F.try_divide(F.col("gain"), F.col("loss"))
    return F.coalesce(1 - F.try_divide(F.lit(1.0), 1 + strength), F.lit(0.5))


def features(prices: DataFrame, lags: int = LAGS) -> DataFrame:
    """``date, ticker, price`` and the features, in the order of ``names``."""
    p = F.col("price")
    base = prices.select("date", "ticker", "price").withColumns({"ret": F.try_divide(p, F.lag(p).over(by_date())) - 1, "delta": p - F.lag(p).over(by_date())})
    base = smoothed(base)
    ret = F.col("ret")
    low, high = (over_full(p, f(p), RANGE) for f in (F.min, F.max))
    columns = {f"ret_lag_{k}": F.lag(ret, k - 1).over(by_date()) if k > 1 else ret for k in range(1, lags + 1)}
    columns |= {f"vol_{w}": over_full(ret, F.stddev_samp(ret), w) for w in VOLATILITY}
    columns |= {f"mom_{w}": F.try_divide(p, F.lag(p, w).over(by_date())) - 1 for w in MOMENTUM}
    columns |= {f"ma_gap_{w}": F.try_divide(p, over_full(p, F.avg(p), w)) - 1 for w in GAPS}
    columns |= {"range_position": F.try_divide(p - low, high - low), f"rsi_{RSI}": relative_strength()}
    columns |= {"weekday": F.weekday("date").cast("double"), "month": F.month("date").cast("double")}
    wide = base.withColumns(columns)
    return wide.select("date", "ticker", "price", *(finite(n).alias(n) for n in names(lags)))
