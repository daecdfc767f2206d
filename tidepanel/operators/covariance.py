"""Covariance, Gerber covariance and shares of risk over long returns: matrix products by block, joins and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.frames import aligned


def means(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return returns.groupBy(*by, "ticker").agg(F.avg("return").alias("mean"))


#: Tickers of a slice, and days of a stretch, that are multiplied in one group.
SLICE, STRETCH = 256, 1024


def products(panel: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``i, j, product, dates``: the sum of the products of two tickers over the dates of an aligned panel, for all pairs of
    each group of ``by``.

    Tickers are dealt to slices and dates to stretches; each group multiplies two slices over one stretch as matrices,
    so rows are copied once for each slice, not for each ticker."""
    tickers = Window.partitionBy(*by, "date").orderBy("ticker")
    numbered = panel.select(*by, "date", "ticker", F.col(column).cast("double").alias("x"), F.floor((F.row_number().over(tickers) - 1) / SLICE).alias("slice"), F.floor((F.count("*").over(Window.partitionBy(*by, "date")) - 1) / SLICE).alias("last"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda other: F.struct(F.least("slice", other).alias("low"), F.greatest("slice", other).alias("high")))
    rows = numbered.select(*by, "date", "ticker", "x", "slice", F.floor(F.unix_date(F.col("date").cast("date")) / STRETCH).alias("stretch"), F.explode(pair).alias("p"))

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        one, both = group["slice"].min(), group["slice"].nunique() > 1
        at, days = pd.factorize(group["date"])
        of, names = pd.factorize(group["ticker"], sort=True)
        x = np.zeros((len(days), len(names)))
        x[at, of] = group["x"]
        low = np.zeros(len(names), bool)
        low[of] = group["slice"] == one
        left, right = np.flatnonzero(low), np.flatnonzero(~low if both else low)
        product = x[:, left].T @ x[:, right]
        i, j = np.repeat(names[left], len(right)), np.tile(names[right], len(left))
        out = pd.DataFrame({**{c: group[c].iloc[0] for c in by}, "i": i, "j": j, "product": product.ravel(), "dates": len(days)})
        return pd.concat([out, out.rename(columns={"i": "j", "j": "i"})[out.columns]]) if both else out

    kinds = "".join(f"{c} {panel.schema[c].dataType.simpleString()}, " for c in by)
    parts = rows.groupBy(*by, "stretch", "p.low", "p.high").applyInPandas(multiply, kinds + "i string, j string, product double, dates long")
    return parts.groupBy(*by, "i", "j").agg(F.sum("product").alias("product"), F.sum("dates").alias("dates"))


def covariance(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``i, j, cov``: sample covariance over the dates on which every ticker has a return; of each group of ``by``."""
    whole = aligned(returns, "return", by)
    centred = whole.withColumn("apart", F.col("return") - F.avg("return").over(Window.partitionBy(*by, "ticker")))
    return products(centred, "apart", by).select(*by, "i", "j", F.try_divide("product", F.col("dates") - 1).alias("cov"))


def gerber(returns: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """``i, j, cov``: moves beyond ``threshold`` deviations count, together for and apart against; of each group of ``by``."""
    deviation = F.stddev_samp("return")
    whole = aligned(returns, "return", by).withColumn("sd", deviation.over(Window.partitionBy(*by, "ticker")))
    sign = F.when(F.col("return") >= threshold * F.col("sd"), 1).when(F.col("return") <= -threshold * F.col("sd"), -1).otherwise(0)
    sds = whole.groupBy(*by, F.col("ticker").alias("i")).agg(deviation.alias("sd_i"))
    joint = products(whole.withColumn("sign", sign), "sign", by).join(sds, [*by, "i"]).select(*by, "i", "j", F.col("product").alias("h"), "sd_i")
    # What the diagonal says of a row's tickers, without making the products again.
    diagonal = lambda column, end: F.max(F.when(F.col("i") == F.col("j"), F.col(column))).over(Window.partitionBy(*by, end))
    scaled = joint.withColumns({"h_i": diagonal("h", "i"), "h_j": diagonal("h", "j"), "sd_j": diagonal("sd_i", "j")})
    share = F.coalesce(F.try_divide(F.col("h"), F.sqrt(F.col("h_i") * F.col("h_j"))), (F.col("i") == F.col("j")).cast("double"))
    return scaled.select(*by, "i", "j", (share * F.col("sd_i") * F.col("sd_j")).alias("cov"))


def gerber_signs(returns: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """``i, j, cov``: the older statistic, by signs alone: how often two tickers move the same way, beyond ``threshold``, as
    a share of what lies beyond it, none to all, times both population deviations. It need not be positive definite."""
    whole = aligned(returns, "return", by).withColumn("way", F.signum("return")).withColumn("moved", F.abs("way"))
    sds = whole.groupBy(*by, "ticker").agg(F.stddev_pop("return").alias("sd"))
    of = lambda end: sds.select(*by, F.col("ticker").alias(end), F.col("sd").alias(f"sd_{end}"))
    moved = products(whole, "moved", by).select(*by, "i", "j", F.col("product").alias("both"))
    joint = products(whole, "way", by).join(moved, [*by, "i", "j"]).join(of("i"), [*by, "i"]).join(of("j"), [*by, "j"])
    same = (F.col("product") + F.col("both")) / 2 / F.col("dates")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - threshold) / (1 - threshold)))
    return joint.select(*by, "i", "j", (share * F.col("sd_i") * F.col("sd_j")).alias("cov"))


def inverse_variance(cov: DataFrame) -> DataFrame:
    """``ticker, weight`` from the diagonal alone."""
    own = cov.where("i = j").select(F.col("i").alias("ticker"), F.try_divide(F.lit(1.0), "cov").alias("inverse"))
    return own.select("ticker", (F.col("inverse") / F.sum("inverse").over(Window.partitionBy())).alias("weight"))


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """``strategy, ticker, share`` of the variance; equal shares where there is none."""
    w = weights.select("strategy", F.col("ticker").alias("i"), F.col("weight").alias("w_i"))
    v = weights.select("strategy", F.col("ticker").alias("j"), F.col("weight").alias("w_j"))
    parts = cov.join(w, "i").join(v, ["strategy", "j"]).groupBy("strategy", "i").agg(F.sum(F.col("w_i") * F.col("cov") * F.col("w_j")).alias("part"))
    one = Window.partitionBy("strategy")
    total = F.sum("part").over(one)
    share = F.when(total > 0, F.col("part") / total).otherwise(1.0 / F.count("*").over(one))
    return parts.select("strategy", F.col("i").alias("ticker"), share.alias("share"))


def variance_residuals(weights: DataFrame, cov: DataFrame, low: float, high: float, cap: tuple[tuple[str, ...], float] | None = None, near: float = 1e-5) -> DataFrame:
    """How far ``strategy, ticker, weight`` are from the least variance within ``low`` and ``high`` and, if given, a cap on
    the sum of some tickers: ``residual``, in shares of the variance, 0 where nothing is amiss.

    What a ticker adds at the margin is level for all that are free to move; those of the group whose cap is reached may lie
    below. A ticker at its lower bound adds no less than the level, one at its upper bound no more. What exceeds a bound or
    the cap, or is missing from 1, counts too."""
    w = weights.select("strategy", F.col("ticker").alias("i"), F.col("weight").alias("w_i"))
    v = weights.select("strategy", F.col("ticker").alias("j"), F.col("weight").alias("w_j"))
    of = Window.partitionBy("strategy")
    slopes = cov.join(v, "j").groupBy("strategy", "i").agg(F.sum(F.col("cov") * F.col("w_j")).alias("s")).join(w, ["strategy", "i"])
    rows = slopes.withColumn("g", F.col("s") / F.sum(F.col("s") * F.col("w_i")).over(of))
    member = F.col("i").isin(list(cap[0])) if cap else F.lit(False)
    held = F.sum(F.when(member, F.col("w_i")).otherwise(0.0)).over(of)
    reached = (held >= cap[1] - near) if cap else F.lit(False)
    rows = rows.withColumns({"inside": member & reached, "over": F.greatest(held - cap[1], F.lit(0.0)) if cap else F.lit(0.0), "at_low": F.col("w_i") <= low + near, "at_high": F.col("w_i") >= high - near})
    free = ~F.col("at_low") & ~F.col("at_high")
    level = lambda inside: F.avg(F.when(free & (F.col("inside") == inside), F.col("g"))).over(of)
    rows = rows.withColumns({"out": level(False), "in": level(True)}).withColumn("level", F.coalesce(F.when(F.col("inside"), F.col("in")), "out", "in"))
    apart = F.col("g") - F.col("level")
    amiss = F.when(free, F.abs(apart)).when(F.col("at_low"), F.greatest(-apart, F.lit(0.0))).otherwise(F.greatest(apart, F.lit(0.0)))
    beyond = F.greatest(low - F.col("w_i"), F.col("w_i") - high, F.lit(0.0)) + F.abs(F.sum("w_i").over(of) - 1)
    wrong = F.when(F.col("inside"), F.greatest(F.coalesce(F.col("in") - F.col("out"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return rows.select("strategy", F.col("i").alias("ticker"), (amiss + beyond + wrong + F.col("over")).alias("residual"))


def tail_mean(series: DataFrame, alpha: float = 0.05, by: str = "strategy") -> DataFrame:
    """``cvar``: the mean loss of the worst share ``alpha`` of each series, with part of a row where the share needs it."""
    place = Window.partitionBy(by).orderBy("return", "date")
    rows = series.withColumns({"place": F.row_number().over(place), "k": F.count("*").over(Window.partitionBy(by)) * alpha})
    counted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("k") - F.col("place") + 1))
    return rows.groupBy(by).agg((-F.sum(F.col("return") * counted) / F.first("k")).alias("cvar"))
