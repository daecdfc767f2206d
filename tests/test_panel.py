"""The panel operators: stores and upserts, features, splits, metrics and the SQL surface."""

import math
import os
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.features import features, names, smoothed
from tidepanel.functions.returns import log_returns, simple_returns
from tidepanel.operators.boosting import Settings
from tidepanel.operators import forecast as fc, metrics as fm, performance as perf, splits as sp
from tidepanel.plans import service, sql
from tidepanel.sources.frames import Frame, aligned, to_long, to_wide
from tidepanel.sources.market import Market, SourceError, from_provider, wanted
from tidepanel.sources import store as store_module
from tidepanel.sources.store import ConcurrentWrite, PriceStore
from tidepanel.sources.synthetic import seed, synthetic_prices
from tidepanel.streaming.ingest import bar_stream, ingest

NAMES = ["AAA", "BBB", "CCC"]


@pytest.fixture(scope="module")
def prices(spark):
    return synthetic_prices(spark, NAMES, date(2018, 1, 1), date(2019, 7, 1)).cache()


def as_bars(prices):
    p = F.col("price")
    return prices.select("date", "ticker", *(p.alias(c) for c in ("open", "high", "low", "close", "adj_close")), F.lit(1000).cast("long").alias("volume"))


def wide(frame, value="price"):
    return frame.toPandas().pivot(index="date", columns="ticker", values=value).sort_index()


def test_synthetic_prices_are_the_seeded_walk(spark, prices):
    got = wide(prices)
    days = pd.bdate_range("2018-01-01", "2019-06-30")
    assert list(got.index) == [d.date() for d in days]
    s = seed("aaa")
    shocks = np.random.Generator(np.random.PCG64(s)).normal(0.08 / 252, 0.24 / np.sqrt(252), len(days))
    assert np.allclose(got["AAA"], 100 * (0.5 + s % 1000 / 500) * np.cumprod(1 + shocks))


def test_store_upserts(spark, prices, tmp_path):
    store = PriceStore(spark, str(tmp_path / "store"))
    assert not store.exists() and store.scan().count() == 0
    bars = as_bars(prices)
    first = store.write(bars, datetime(2020, 1, 1))
    n = bars.count()
    assert (first.tickers, first.rows_in, first.rows_added, first.rows_written, first.revised) == (3, n, n, n, 0)
    again = store.write(bars.where("ticker = 'AAA'"), datetime(2020, 1, 2))
    assert again.rows_added == 0 and again.revised == 0 and store.scan().count() == n
    assert {r.ticker: r.vintages for r in sql.coverage(store.scan()).collect()} == {t: 1 for t in NAMES}
    assert {r.ingested_at: r.tickers for r in sql.vintages(store.scan()).collect()} == {datetime(2020, 1, 1): 2, datetime(2020, 1, 2): 1}
    changed = bars.where("ticker = 'BBB'").withColumn("adj_close", F.when(F.col("date") == "2018-01-03", F.col("adj_close") * 1.1).otherwise(F.col("adj_close") * (1 + 1e-13))).withColumn("ticker", F.lower("ticker"))
    third = store.write(changed, datetime(2020, 1, 3))
    assert third.revised == 1 and third.revisions.first()["date"] == date(2018, 1, 3) and store.scan().count() == n
    assert store.read(["bbb"], date(2018, 1, 2), date(2018, 1, 4)).count() == 2  # the end is left out
    assert [r.ticker for r in store.tickers().collect()] == NAMES
    assert store.read_wide(["AAA", "BBB"]).columns == ["date", "AAA", "BBB"]
    plan = store.scan(["AAA"], date(2018, 2, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan or "ticker#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(date" in plan
    answer, more = service.ask(store, "SELECT ticker, max(date) AS d FROM prices GROUP BY ticker ORDER BY ticker", 2)
    assert more and [tuple(r) for r in answer.collect()] == [("AAA", "2019-06-28"), ("BBB", "2019-06-28")]
    assert service.coverage(store)["total_rows"] == n
    store.clear()
    assert not store.exists()


def folders(store):
    return sorted(os.listdir(store.root))


def test_store_commits_versions(spark, prices, tmp_path):
    store, bars = PriceStore(spark, str(tmp_path / "store")), as_bars(prices)
    store.write(bars.where("ticker <> 'CCC'"), datetime(2020, 1, 1)).release()
    seen, n = store.scan(), store.scan().count()
    changed = bars.where("ticker = 'BBB'").withColumn("adj_close", F.col("adj_close") * 2)
    report = store.write(changed, datetime(2020, 1, 2))
    # A reader of before sees what was there; what is not needed any more stays until it is cleared away.
    assert seen.count() == n and seen.where("ticker = 'BBB'").agg(F.sum("adj_close")).first()[0] * 2 == pytest.approx(store.scan(["BBB"]).agg(F.sum("adj_close")).first()[0])
    assert report.revised == report.revisions.count() > 0 and folders(store) != ["bars", "manifest"]
    report.release()
    assert folders(store) == ["bars", "manifest"]
    empty = store.write(bars.where("false"))
    assert empty.rows_in == empty.rows_written == 0 and store.tickers().count() == 2
    empty.release()
    half = spark.createDataFrame([(date(2020, 1, 1), "A/B=1", 1.0), (date(2020, 1, 1), "0700", 2.0)], "date date, ticker string, adj_close double")
    store.write(half).release()
    assert {tuple(r) for r in store.scan(["a/b=1", "0700"]).select("ticker", "adj_close").collect()} == {("A/B=1", 1.0), ("0700", 2.0)}
    assert store.vacuum() == 0 and store.scan().count() == n + 2
    store.write(bars.where("ticker <> 'CCC'"), datetime(2020, 1, 3)).release()
    store.write(half).release()
    assert store.vacuum() == 3 and store.scan().count() == n + 2 and folders(store) == ["bars", "manifest"]


def test_two_writers_lose_nothing(spark, prices, tmp_path):
    store, bars = PriceStore(spark, str(tmp_path / "store")), as_bars(prices)
    store.write(bars.where("ticker = 'AAA' AND date < '2018-06-01'")).release()
    parts = [bars.where("ticker = 'BBB'"), bars.where("ticker = 'CCC'"), bars.where("ticker = 'AAA' AND date >= '2018-06-01' AND date < '2019-01-01'"), bars.where("ticker = 'AAA' AND date >= '2019-01-01'")]
    with ThreadPoolExecutor(4) as pool:
        reports = list(pool.map(lambda part: PriceStore(spark, store.root).write(part), parts))
    assert store.scan().count() == bars.count() == store.scan().select("ticker", "date").distinct().count()
    for report in reports:
        report.release()
    assert folders(store) == ["bars", "manifest"]


def test_a_writer_gives_up_rather_than_lose_rows(spark, prices, tmp_path, monkeypatch):
    store, bars = PriceStore(spark, str(tmp_path / "store")), as_bars(prices)
    store.write(bars.where("ticker = 'AAA'")).release()
    commit = store._commit

    def beaten(number, of):  # someone else writes the same ticker first, each time
        PriceStore(spark, store.root)._commit(number, of | {"AAA": "other%d" % number})
        return commit(number, of)

    monkeypatch.setattr(store, "_commit", beaten)
    read = store._read
    monkeypatch.setattr(store, "_read", lambda of: read({}) if any(v.startswith("other") for v in of.values()) else read(of))
    with pytest.raises(ConcurrentWrite):
        store.write(bars.where("ticker = 'AAA' AND date < '2018-02-01'"))
    assert "staged" not in "".join(folders(store))
    broken = PriceStore(spark, str(tmp_path / "broken"))
    broken.write(bars.where("ticker = 'AAA'")).release()
    with open(f"{broken.root}/manifest/000000000002.json", "w") as half:
        half.write('{"AAA": ')
    assert broken.scan().count() == bars.where("ticker = 'AAA'").count()
    monkeypatch.setattr(store_module, "WAITS", 2)
    with pytest.raises(ConcurrentWrite, match="never finished"):
        broken.write(bars.where("ticker = 'BBB'"))


@pytest.mark.parametrize("query", ["DROP TABLE prices", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "CREATE TABLE t AS SELECT 1", "SET x = 1", "SELEC 1", "SELECT * FROM parquet.`/tmp`",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT `java_method`('java.lang.System', 'exit', 1)", "SELECT 1 WHERE try_reflect('a', 'b') = 'x'", "SELECT builtin.reflect('a', 'b')",
    "SELECT (SELECT max(reflect('a', 'b')))", "WITH a AS (SELECT reflect('a', 'b') x) SELECT * FROM a", "SELECT 1 WHERE EXISTS (SELECT reflect('a', 'b'))", "SELECT x FROM VALUES (1) AS t(x) ORDER BY reflect('a', 'b')",
    "SELECT rank() OVER w FROM VALUES (1) AS t(x) WINDOW w AS (ORDER BY reflect('a', 'b'))", "SELECT * FROM VALUES (reflect('a', 'b')) AS t(x)", "SELECT transform(array(1), x -> reflect('a', 'b'))", "SELECT 1 LIMIT length(reflect('a', 'b'))",
    "SELECT x FROM VALUES (1) AS t(x) LATERAL VIEW explode(array(reflect('a', 'b'))) e", "SELECT * FROM VALUES (1) AS t(x), LATERAL (SELECT reflect('a', 'b'))", "SELECT input_file_name()", "SELECT x FROM VALUES (1) AS t(x) WHERE x IN (SELECT reflect('a', 'b'))",
    "SELECT identifier('reflect')('java.lang.System', 'getProperty', 'user.home')", "SELECT identifier('java_method')('java.lang.Math', 'abs', -5)", "SELECT 1 WHERE identifier('ref' || 'lect')('a', 'b') = 'x'", "SELECT * FROM identifier('prices')",
    "SELECT identifier('current_user')()", "SELECT transform(array(1), x -> identifier('reflect')('a', 'b'))", "SELECT sum(identifier('java_method')('a', 'b')) OVER w FROM VALUES (1) AS t(x) WINDOW w AS (ORDER BY x)", "SELECT size(sequence(1, 1000000000))"])
def test_guard_refuses(spark, query):
    with pytest.raises(Exception) as error:
        sql.guarded(spark, query)
    assert isinstance(error.value, ValueError) or "UNSUPPORTED" in str(error.value) or "TABLE_OR_VIEW_NOT_FOUND" in str(error.value)


@pytest.mark.parametrize("query", ["SELECT 'create; drop' AS x", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "SELECT x, rank() OVER (ORDER BY x) r FROM VALUES (1), (2) AS t(x) WHERE x IN (SELECT 1) ORDER BY x LIMIT 1", "(SELECT 1) UNION (SELECT 2)", "SELECT sum(x) OVER w AS s, date_add(DATE '2020-01-01', 1) AS d, CAST(x AS STRING) AS t FROM VALUES (1) AS t(x) WINDOW w AS (ORDER BY x)",
    "SELECT x, count(*) AS n, max(y) AS y FROM VALUES (1, 2) AS t(x, y) WHERE EXISTS (SELECT 1) GROUP BY x HAVING count(*) > 0",
    "SELECT t.*, CASE WHEN x BETWEEN 1 AND 2 THEN 'a' ELSE 'b' END AS c, y[0] AS y0, -x AS m FROM VALUES (1, array(2)) AS t(x, y) WHERE x IS NOT NULL", "SELECT x, e FROM VALUES (1) AS t(x) LATERAL VIEW explode(array(1, 2)) v AS e", "SELECT DATE '2020-01-31' + INTERVAL 1 DAY AS d, try_divide(1, 0) AS q, count(DISTINCT x) AS n FROM VALUES (1) AS t(x) GROUP BY ALL"])
def test_guard_lets_reading_pass(spark, query):
    assert sql.guarded(spark, query)[0].count() >= 1


def test_guard_stops_what_takes_too_long(spark):
    with pytest.raises(ValueError, match="took more than"):
        sql.guarded(spark, "SELECT count(*) FROM range(1000000000000000) WHERE sin(id) > 2", seconds=3)
    assert sql.guarded(spark, "SELECT 1 AS x")[0].first().x == 1


def test_market(spark, prices, tmp_path):
    market = Market(spark)
    a = market.prices(["aaa", "BBB", "AAA"], date(2018, 1, 1), date(2018, 3, 1))
    assert market.prices(["BBB", "AAA"], date(2018, 1, 1), date(2018, 3, 1)) is a
    assert market.returns(["AAA"], date(2018, 1, 1), date(2018, 3, 1)).count() == a.where("ticker = 'AAA'").count() - 1
    frame = service.panel(market, ["AAA", "BBB"], date(2018, 1, 1), date(2018, 1, 5))
    assert frame.index[0] == "2018-01-01" and frame.columns == ["AAA", "BBB"] and frame.long(spark).count() == 8
    with pytest.raises(ValueError):
        wanted(["A B"])
    with pytest.raises(ValueError):
        wanted(["A"], date(2020, 1, 1), date(2020, 1, 1))
    with pytest.raises(ValueError):
        Frame(["a"], ["x"], [])
    stored = Market(spark, "parquet", PriceStore(spark, str(tmp_path / "s")))
    report, shown = stored.ingest(as_bars(prices))
    assert report.rows_added == prices.count() and shown.count() == 0
    with pytest.raises(SourceError, match="ZZZ"):
        stored.prices(["AAA", "ZZZ"], date(2018, 1, 1), date(2018, 3, 1))
    provider = spark.createDataFrame([(date(2020, 1, 1), 1.0, None, 2.0)], "date date, `close|aaa` double, `adj_close|aaa` double, `close|b` double")
    assert sorted((r.ticker, r.adj_close) for r in from_provider(provider, ["close", "adj_close"]).collect()) == [("AAA", 1.0), ("B", 2.0)]


def test_frames(spark):
    long = spark.createDataFrame([(date(2020, 1, d), t, float(d)) for d in (1, 2, 3) for t in "AB" if (d, t) != (2, "B")] + [(date(2020, 1, 1), "C", None)], "date date, ticker string, price double")
    assert {r["date"].day for r in aligned(long).collect()} == {1, 3}
    back = to_long(to_wide(long, ["A", "B"]))
    assert back.count() == 5
    assert Frame.of(to_wide(long, ["A", "B"])).data == [[1.0, 1.0], [2.0, None], [3.0, 3.0]]


def test_features_equal_pandas_and_never_look_ahead(spark, prices):
    got = features(prices).where("ticker = 'BBB'").orderBy("date").toPandas()
    p = wide(prices)["BBB"].reset_index(drop=True)
    ret, delta = p.pct_change(fill_method=None), p.diff()
    gain, loss = (x.ewm(alpha=1 / 14, adjust=False).mean() for x in (delta.clip(lower=0), -delta.clip(upper=0)))
    want = {f"ret_lag_{k}": ret.shift(k - 1) for k in range(1, 11)} | {f"vol_{w}": ret.rolling(w).std() for w in (5, 21, 63)} | {f"mom_{w}": p / p.shift(w) - 1 for w in (5, 21, 63)}
    want |= {f"ma_gap_{w}": p / p.rolling(w).mean() - 1 for w in (21, 63)}
    want |= {"range_position": (p - p.rolling(21).min()) / (p.rolling(21).max() - p.rolling(21).min()), "rsi_14": (1 - 1 / (1 + gain / loss)).where(loss > 0, 0.5).fillna(0.5)}
    for name, series in want.items():
        assert np.allclose(got[name], series, equal_nan=True, atol=1e-9), name
    assert list(got.columns) == ["date", "ticker", "price", *names()]
    cut = features(prices.where("date < '2018-12-01'")).where("ticker = 'BBB'").orderBy("date").toPandas()
    assert np.allclose(cut[names()], got[names()][: len(cut)], equal_nan=True, atol=1e-9)
    rising = spark.createDataFrame([(date(2020, 1, d), "A", float(d)) for d in range(1, 20)], "date date, ticker string, price double")
    assert {r.rsi_14 for r in features(rising).collect()} == {0.5}


@pytest.mark.parametrize("block", [1, 7, 256])
def test_smoothed_means_by_block(spark, block):
    rng = np.random.default_rng(6)
    rows = []
    for ticker in ("X", "Y", "Z"):
        moves = rng.normal(size=400)
        moves[rng.random(400) < 0.2] = np.nan
        moves[: 1 + 5 * (ticker == "Y")] = np.nan
        moves = np.full(400, np.nan) if ticker == "Z" else moves
        rows += [(ticker, i, None if np.isnan(m) else float(m), "x") for i, m in enumerate(moves)]
    frame = spark.createDataFrame(rows, "ticker string, date int, delta double, f string")
    got = smoothed(frame, block=block).toPandas().sort_values(["ticker", "date"])
    assert list(got.columns) == ["ticker", "date", "delta", "f", "gain", "loss"] and len(got) == 1200
    for _, own in got.groupby("ticker"):
        for name, moves in (("gain", own["delta"].clip(lower=0)), ("loss", -own["delta"].clip(upper=0))):
            want = moves.ewm(alpha=1 / 14, adjust=False).mean()
            assert (own[name].isna() == want.isna()).all() and (own[name] - want).abs().max() < 1e-13 or want.isna().all()


def test_splits_do_not_leak(prices):
    rows, failed = sp.splits(prices, 0.7)
    assert failed.count() == 0
    table = rows.where("ticker = 'AAA'").orderBy("date").toPandas()
    n = len(table)
    assert table["is_train"].sum() == math.ceil(n * 0.7) and (table["date"] < table["target_date"]).all()
    train = table[table["is_train"]]
    assert abs(train["vol_5_scaled"].mean()) < 1e-9 and abs(train["vol_5_scaled"].std(ddof=0) - 1) < 1e-9
    assert np.allclose(table["target_scaled"] * table["y_scale"] + table["y_mean"], table["target"])
    assert np.allclose(table["prev_price"] * (1 + table["target"]), table["actual_price"])
    _, failed = sp.splits(prices.where("date < '2018-06-01'"), 0.7)
    assert {r.reason for r in failed.collect()} == {"too few training rows"}


def test_naive_forecast_is_the_yardstick(prices):
    forecast, _ = fc.naive(prices)
    rows = fm.metrics(forecast).collect()
    assert len(rows) == 3 and all(abs(r.mase - 1) < 1e-9 and r.directional_accuracy is None for r in rows)
    assert fm.metrics(forecast.limit(1)).first().mase is None
    assert {r.metric for r in fm.summary(fm.metrics(forecast)).collect()} >= {"rmse", "mase"}
    with pytest.raises(ValueError, match="not available"):
        fc.forecast(prices, "torch_lstm")


def test_trees_do_not_beat_a_random_walk(prices):
    told = []
    forecast, failed = fc.boosted(prices, fc.Params(trees=Settings(trees=5, leaves=4)), told.append)
    assert all(r.mase > 0.9 for r in fm.metrics(forecast).collect()) and failed.count() == 0
    assert told == sorted(told) and told[-1] == 1.0 and len(told) >= 2


def test_performance(spark):
    values = [0.1, -0.05, 0.02, -0.2, 0.1]
    rows = spark.createDataFrame([("s", date(2020, 1, i + 1), v) for i, v in enumerate(values)] + [("flat", date(2020, 1, 1), 0.0), ("none", date(2020, 1, 1), None)], "strategy string, date date, return double")
    got = {r.strategy: r for r in perf.performance(rows).collect()}
    r = np.array(values)
    grown = np.cumprod(1 + r)
    assert set(got) == {"s", "flat"} and got["flat"].sharpe == 0 and got["flat"].sortino == 0
    assert math.isclose(got["s"].max_drawdown, (grown / np.maximum.accumulate(grown) - 1).min())
    assert math.isclose(got["s"].sharpe, r.mean() * 252 / (r.std(ddof=1) * np.sqrt(252)))
    assert math.isclose(got["s"].sortino, r.mean() * 252 / (np.sqrt((np.minimum(r, 0) ** 2).mean()) * np.sqrt(252)))
    ten = spark.createDataFrame([(f"s{i}", float(i)) for i in range(10)], "strategy string, annual_volatility double")
    assert perf.by_risk(ten, 0.5).first().strategy == "s4" and perf.by_risk(ten, 9).first().strategy == "s9"  # 4.5 goes to 4


def test_returns(spark):
    rows = spark.createDataFrame([(date(2020, 1, i + 1), "A", v) for i, v in enumerate([1.0, 2.0, None, 4.0, 0.0, 1.0])], "date date, ticker string, price double")
    assert [r["return"] for r in simple_returns(rows).orderBy("date").collect()] == [1.0, -1.0]
    assert [round(r["return"], 6) for r in log_returns(rows).orderBy("date").collect()] == [0.693147]


def test_stream_replay_equals_batch(spark, prices, tmp_path):
    store = PriceStore(spark, str(tmp_path / "live"))
    bars = as_bars(prices)
    for year in (2018, 2019):
        bars.where(F.year("date") == year).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(bar_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    columns = bars.columns
    assert store.scan().select(columns).exceptAll(bars).count() == 0 and store.scan().count() == bars.count()
