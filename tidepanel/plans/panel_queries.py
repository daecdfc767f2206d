"""Registered queries over the derived bars, with their DuckDB SQL: store, upserts, reshaping, returns, features."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.features import GAPS, LAGS, MOMENTUM, RANGE, RSI, VOLATILITY, features, names
from ..functions.returns import log_returns, simple_returns
from ..sources.bars import ORACLE as BARS, bars, prices
from ..sources.frames import aligned, to_long, to_wide
from .. import shared
from ..shared import shared_dir
from ..sources.store import PriceStore, conform, merge, overlap, revisions
from ..streaming import live
from . import sql
from .registry import query

#: Digits that results are compared to: sums come in any order.
DIGITS = 6
WIDE = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def rounded(frame: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Floating-point columns rounded, and minus zero made zero."""
    kinds = dict(frame.dtypes)
    return frame.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in frame.columns))


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with an ingestion stamp, by the year of the bar: what a store filled year by year holds."""
    stamp = F.to_timestamp_ntz(F.concat(F.year("date").cast("string"), F.lit("-12-31 00:00:00")))
    return bars(spark, sf_dir).withColumn("ingested_at", stamp)


STAMPED = BARS + ", stamped AS (SELECT *, CAST(CAST(year(date) AS VARCHAR) || '-12-31 00:00:00' AS TIMESTAMP) AS ingested_at FROM bars)"


def store(spark: SparkSession, *snapshots: DataFrame, order: str | None = None) -> tuple[PriceStore, list]:
    """A price store of its own, filled with one snapshot after the other, and what each upsert reported."""
    out = PriceStore(spark, f"{shared_dir(spark)}/prices-{uuid.uuid4().hex}")
    return out, [out.write(s, datetime(2020, 1, 1 + i), order if order in s.columns else None) for i, s in enumerate(snapshots)]


@query("bars", BARS + "SELECT * FROM bars")
def _bars(spark, sf_dir):
    return bars(spark, sf_dir)


@query("store_scan", BARS + "SELECT date, ticker, open, high, low, close, adj_close, volume FROM bars WHERE ticker IN ('ECONOMY', 'SMALL') AND date >= DATE '1996-01-01' AND date < DATE '1998-01-01'")
def _scan(spark, sf_dir):
    return store(spark, bars(spark, sf_dir))[0].scan(["economy", "small"], date(1996, 1, 1), date(1998, 1, 1)).drop("ingested_at")


@query("store_tickers", BARS + "SELECT DISTINCT ticker FROM bars")
def _tickers(spark, sf_dir):
    return store(spark, bars(spark, sf_dir))[0].tickers()


@query("read_wide", BARS + "SELECT date, " + ", ".join(f"first(adj_close) FILTER (ticker = '{t}') AS {t}" for t in WIDE) + " FROM bars GROUP BY date")
def _wide(spark, sf_dir):
    return store(spark, bars(spark, sf_dir))[0].read_wide(WIDE)


@query("unpivot_long", BARS + "SELECT date, ticker, adj_close AS price FROM bars WHERE adj_close IS NOT NULL")
def _long(spark, sf_dir):
    return to_long(to_wide(bars(spark, sf_dir), WIDE, "adj_close"))


@query("coverage", STAMPED + "SELECT ticker, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, max(ingested_at) AS last_ingested, count(DISTINCT ingested_at) AS vintages FROM stamped GROUP BY ticker")
def _coverage(spark, sf_dir):
    return sql.coverage(stamped(spark, sf_dir))


@query(
    "gaps",
    BARS + """, g AS (SELECT ticker, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS gap_start, date AS gap_end FROM bars)
SELECT ticker, gap_start, gap_end, date_diff('day', gap_start, gap_end) AS gap_days FROM g WHERE date_diff('day', gap_start, gap_end) > 1""",
)
def _gaps(spark, sf_dir):
    return sql.gaps(bars(spark, sf_dir), 1)


@query("vintages", STAMPED + "SELECT ingested_at, count(*) AS rows, count(DISTINCT ticker) AS tickers FROM stamped GROUP BY ingested_at")
def _vintages(spark, sf_dir):
    return sql.vintages(stamped(spark, sf_dir))


@query("vintage_tags", STAMPED + "SELECT max(ingested_at) AS last_ingested, min(date) AS first_date, max(date) AS last_date FROM stamped WHERE ticker IN ('ECONOMY', 'SMALL')")
def _tags(spark, sf_dir):
    return sql.vintage_tags(stamped(spark, sf_dir), ["economy", "small"])


@query("guarded_sql", BARS + "SELECT ticker, strftime(max(date), '%Y-%m-%d') AS last_date, sum(volume)::BIGINT AS volume FROM bars GROUP BY ticker")
def _guarded(spark, sf_dir):
    bars(spark, sf_dir).createOrReplaceTempView("tidepanel_bars")
    return sql.guarded(spark, "WITH b AS (SELECT * FROM tidepanel_bars) SELECT ticker, max(date) AS last_date, sum(volume) AS volume FROM b GROUP BY ticker")[0]


# Two snapshots of one store: the stored one ends before 2000, the incoming one begins in 1998 and restates bars whose
# volume ends in 7, and repeats each of its rows with an older price before it.
def stored(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).where(F.col("date") < F.lit(date(2000, 1, 1)))


def raw_incoming(spark, sf_dir) -> DataFrame:
    rows = bars(spark, sf_dir).where(F.col("date") >= F.lit(date(1998, 1, 1)))
    price = F.round(F.col("adj_close") * F.when(F.col("volume") % 10 == 7, 1.01).otherwise(1.0), 6)
    rows = rows.withColumn("adj_close", price).withColumn("ticker", F.lower("ticker"))
    old = rows.withColumn("adj_close", F.col("adj_close") + 1).withColumn("seq", F.lit(0))
    return old.unionByName(rows.withColumn("seq", F.lit(1)))


SNAPSHOTS = BARS + """, stored AS (SELECT * FROM bars WHERE date < DATE '2000-01-01'),
incoming AS (SELECT * REPLACE (round(adj_close * CASE WHEN volume % 10 = 7 THEN 1.01 ELSE 1.0::DOUBLE END, 6) AS adj_close) FROM bars WHERE date >= DATE '1998-01-01')
"""


@query("upsert_conform", SNAPSHOTS + "SELECT * FROM incoming")
def _conform(spark, sf_dir):
    return conform(raw_incoming(spark, sf_dir), "seq").drop("ingested_at")


@query("upsert_revisions", SNAPSHOTS + "SELECT ticker, date, s.adj_close AS old_adj_close, i.adj_close AS new_adj_close FROM stored s JOIN incoming i USING (ticker, date) WHERE abs(i.adj_close - s.adj_close) > 1e-9 * greatest(abs(s.adj_close), 1)")
def _revisions(spark, sf_dir):
    return revisions(stored(spark, sf_dir), conform(raw_incoming(spark, sf_dir), "seq"))


@query("upsert_overlap", SNAPSHOTS + "SELECT ticker, date FROM incoming SEMI JOIN stored USING (ticker, date)")
def _overlap(spark, sf_dir):
    return overlap(stored(spark, sf_dir), conform(raw_incoming(spark, sf_dir), "seq")).select("ticker", "date")


@query("upsert_merge", SNAPSHOTS + "SELECT * FROM incoming UNION ALL BY NAME SELECT * FROM stored ANTI JOIN incoming USING (ticker, date)")
def _merge(spark, sf_dir):
    return merge(stored(spark, sf_dir), conform(raw_incoming(spark, sf_dir), "seq"))


STORED = SNAPSHOTS + """, held AS (SELECT *, TIMESTAMP '2020-01-02' AS ingested_at FROM incoming UNION ALL BY NAME SELECT *, TIMESTAMP '2020-01-01' AS ingested_at FROM stored ANTI JOIN incoming USING (ticker, date))
"""


@query("store_after_upserts", STORED + "SELECT * FROM held")
def _after(spark, sf_dir):
    return store(spark, stored(spark, sf_dir), raw_incoming(spark, sf_dir), order="seq")[0].scan()


@query("store_coverage", STORED + "SELECT ticker, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, max(ingested_at) AS last_ingested, count(DISTINCT ingested_at) AS vintages FROM held GROUP BY ticker")
def _held(spark, sf_dir):
    return sql.coverage(store(spark, stored(spark, sf_dir), raw_incoming(spark, sf_dir), order="seq")[0].scan())


@query(
    "store_upsert_report",
    STORED + """SELECT CAST((SELECT count(DISTINCT ticker) FROM incoming) AS BIGINT) AS tickers, CAST((SELECT count(*) FROM incoming) AS BIGINT) AS rows_in,
CAST((SELECT count(*) FROM incoming ANTI JOIN stored USING (ticker, date)) AS BIGINT) AS rows_added, CAST((SELECT count(*) FROM held WHERE ticker IN (SELECT ticker FROM incoming)) AS BIGINT) AS rows_written,
CAST((SELECT count(*) FROM stored s JOIN incoming i USING (ticker, date) WHERE abs(i.adj_close - s.adj_close) > 1e-9 * greatest(abs(s.adj_close), 1)) AS BIGINT) AS revised""",
)
def _report(spark, sf_dir):
    r = store(spark, stored(spark, sf_dir), raw_incoming(spark, sf_dir), order="seq")[1][1]
    return spark.createDataFrame([(r.tickers, r.rows_in, r.rows_added, r.rows_written, r.revised)], "tickers long, rows_in long, rows_added long, rows_written long, revised long")


ALIGNED = BARS + ", whole AS (SELECT date FROM prices GROUP BY date HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM prices)), aligned AS (SELECT * FROM prices SEMI JOIN whole USING (date))"
RETURNS = ALIGNED + ", lagged AS (SELECT date, ticker, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) AS ratio FROM aligned), returns AS (SELECT date, ticker, ratio - 1 AS r FROM lagged WHERE ratio IS NOT NULL)"


@query("calendar_aligned", ALIGNED + "SELECT date, ticker, price FROM aligned")
def _aligned(spark, sf_dir):
    return aligned(prices(bars(spark, sf_dir))).select("date", "ticker", "price")


def panel_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_returns(aligned(prices(bars(spark, sf_dir))))


@query("simple_returns", RETURNS + 'SELECT date, ticker, round(r, 6) + 0.0 AS "return" FROM returns')
def _simple(spark, sf_dir):
    return rounded(panel_returns(spark, sf_dir))


@query("log_returns", RETURNS + 'SELECT date, ticker, round(ln(ratio), 6) + 0.0 AS "return" FROM lagged WHERE ratio > 0')
def _log(spark, sf_dir):
    return rounded(log_returns(aligned(prices(bars(spark, sf_dir)))))


def feature_sql() -> str:
    """The relation ``featured``, not rounded, after those of the bars."""
    def full(expr: str, value: str, rows: int) -> str:
        over = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN count({value}) {over} >= {rows} THEN {expr} {over} END"

    line = "OVER (PARTITION BY ticker ORDER BY date)"
    low, high = full("min(price)", "price", RANGE), full("max(price)", "price", RANGE)
    columns = {f"ret_lag_{k}": f"lag(ret, {k - 1}) {line}" for k in range(1, LAGS + 1)}
    columns |= {f"vol_{w}": full("stddev_samp(ret)", "ret", w) for w in VOLATILITY}
    columns |= {f"mom_{w}": f"price / lag(price, {w}) {line} - 1" for w in MOMENTUM}
    columns |= {f"ma_gap_{w}": f"price / ({full('avg(price)', 'price', w)}) - 1" for w in GAPS}
    columns |= {"range_position": f"(price - ({low})) / nullif(({high}) - ({low}), 0)", "weekday": "CAST(isodow(date) - 1 AS DOUBLE)", "month": "CAST(month(date) AS DOUBLE)"}
    # The recurrence of the decaying mean, written out as a sum of powers; the first move weighs all that is left.
    keep = f"(1.0 - 1.0 / {RSI})"
    mean = lambda move: f"sum(CASE WHEN n = 2 THEN {move} ELSE {move} / {RSI} END * pow({keep}, -n)) OVER (PARTITION BY ticker ORDER BY date) * pow({keep}, n)"
    columns[f"rsi_{RSI}"] = "coalesce(CASE WHEN loss > 0 THEN 1 - 1 / (1 + gain / loss) END, 0.5)"
    listed = ", ".join(f"{columns[n]} AS {n}" for n in names())
    return (
        BARS + f""", moved AS (SELECT *, price / lag(price) {line} - 1 AS ret, price - lag(price) {line} AS delta, row_number() {line} AS n FROM prices),
smoothed AS (SELECT *, {mean("greatest(delta, 0)")} AS gain, {mean("greatest(-delta, 0)")} AS loss FROM moved), featured AS (SELECT date, ticker, price, {listed} FROM smoothed)"""
    )


FEATURED = feature_sql()


@query("features", FEATURED + "SELECT date, ticker, price, " + ", ".join(f"round({n}, {DIGITS}) + 0.0 AS {n}" for n in names()) + " FROM featured")
def _features(spark, sf_dir):
    return rounded(features(prices(bars(spark, sf_dir))))


@query("live_features", FEATURED + "SELECT date, ticker, price, " + ", ".join(f"round({n}, {DIGITS}) + 0.0 AS {n}" for n in names()) + " FROM featured")
def _live(spark, sf_dir):
    """The bars as a stream of three batches: even years, on the first of a month at twice the price; odd years, which come
    late; the prices that were wrong, restated."""
    path = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    told = shared.stored(prices(bars(spark, sf_dir)), "told")
    even, first = F.year("date") % 2 == 0, F.day("date") == 1
    early = told.where(even).withColumn("price", F.when(first, F.col("price") * 2).otherwise(F.col("price")))
    for stamp, batch in enumerate((early, told.where(~even), told.where(even & first))):
        batch = batch.withColumn("stamp", F.lit(stamp))
        batch.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(batch.schema).parquet(f"{path}/in")
        live.start(live.live_features(stream, F.col("stamp")), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    shared.drop(told)
    return rounded(live.latest(spark, f"{path}/out"))


