"""Features of a stream: replayed in batches, with late and restated prices, against those of the whole."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.functions.features import features, names
from tidepanel.streaming import live

SCHEMA = "date date, ticker string, price double, stamp long, extra string"


@pytest.fixture
def replay(spark, tmp_path):
    def run(batches, order=None):
        told = []
        for batch in batches:
            spark.createDataFrame([(*r, "x") for r in batch], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            query = live.start(live.live_features(stream, order), str(tmp_path / "out"), str(tmp_path / "cp"))
            query.awaitTermination()
            told.append(sum(p["numInputRows"] for p in query.recentProgress))
        return live.latest(spark, str(tmp_path / "out")), told

    return run


def near(rows):
    return {(r.date, r.ticker): tuple(None if r[n] is None else round(r[n], 9) + 0.0 for n in ("price", *names())) for r in rows}


def walk(ticker, days, seed):
    import random

    rng, price, out = random.Random(seed), 50.0, []
    for i in range(days):
        price = max(0.0, round(price + rng.gauss(0, 1), 3)) if i != 40 else 0.0  # a price of zero, too
        out.append((date(2019, 9, 1) + timedelta(days=i + i // 5 * 2), ticker, price, 0))
    return out


def test_replay_in_any_batches_is_what_the_whole_gives(spark, replay):
    a, b, short = walk("A", 500, 1), walk("B", 130, 2), walk("S", 3, 3)
    wrong = [(d, t, p + 5, -1) if i % 97 == 0 else (d, t, p, s) for i, (d, t, p, s) in enumerate(a)]
    late = {7, 300, 301}  # days that come when later ones are long there
    batches = [
        [r for i, r in enumerate(wrong[:350]) if i not in late] + b[:60],
        wrong[350:420] + short + [(None, "A", 1.0, 0), (date(2020, 1, 1), None, 1.0, 0), (b[5][0], "B", None, 9), (b[5][0], "B", math.nan, 9), (b[5][0], "B", math.inf, 9)],
        [wrong[i] for i in late] + [r for i, r in enumerate(a) if i % 97 == 0] + a[:1] + b[60:],
        [(d, t, p + 8, -2) for d, t, p, _ in a[200:210]] + wrong[420:],  # old revisions that come last change nothing
    ]
    got, told = replay(batches, F.col("stamp"))
    whole = spark.createDataFrame([r[:3] for r in a + b + short], "date date, ticker string, price double")
    assert near(got.collect()) == near(features(whole).collect())
    assert all(told)


def test_only_what_changes_is_told(spark, replay, tmp_path):
    rows = walk("A", 200, 4)
    replay([rows[:150], rows[150:152], [(rows[148][0], "A", 1.0, 0)], rows[140:142]])
    counts = {r.batch: r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 150, 1: 2, 2: 4}  # a price restated as it was tells nothing


def test_without_an_order_the_later_batch_counts(replay):
    day = date(2024, 2, 29)
    got, _ = replay([[(day, "A", 3.0, 0), (day, "A", 4.0, 0)], [(day, "A", 2.0, 0)]])
    assert [(r.date, r.price, r.rsi_14, r.weekday, r.month, r.ret_lag_1) for r in got.collect()] == [(day, 2.0, 0.5, 3.0, 2.0, None)]


def test_no_rows_give_none(replay):
    got, _ = replay([[(None, "A", 1.0, 0)]])
    assert got.count() == 0
