"""A price provider as a data source."""

import os
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.sources import provider

CODE = '''
import os
import pandas as pd

def walk(tickers, start, end):
    with open(os.path.join({folder!r}, "asked"), "a") as log:
        log.write(",".join(tickers) + f" {{start}} {{end}}\\n")
    days = pd.date_range("2020-01-01", "2020-01-31")
    return pd.DataFrame([(d.date(), t.lower(), float(i), 7) for t in tickers if t != "NONE" for i, d in enumerate(days)], columns=["date", "ticker", "close", "volume"])

def shaky(tickers, start, end):
    path = os.path.join({folder!r}, "failed-" + tickers[0])
    if not os.path.exists(path):
        open(path, "w").close()
        raise OSError("not now")
    return walk(tickers, start, end)
'''


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("provider"))
    path = os.path.join(folder, "test_provider_module.py")
    with open(path, "w") as out:
        out.write(CODE.format(folder=folder))
    spark.sparkContext.addPyFile(path)
    provider.register(spark)

    def load(function="walk", tickers="aaa,BBB, ccc,NONE,aaa", **options):
        return spark.read.format("prices").options(provider=f"test_provider_module:{function}", tickers=tickers, wait="0", **options).load()

    def asked():
        with open(os.path.join(folder, "asked")) as log:
            lines = sorted(set(log.read().splitlines()))
        os.remove(os.path.join(folder, "asked"))
        return lines

    return load, asked


def test_groups_and_missing_tickers(read):
    load, asked = read
    frame = load(group="2", report="true", start="2020-01-03")
    assert frame.rdd.getNumPartitions() == 2
    bars, missing = provider.split(frame)
    assert {(r.ticker, r.n, r.low, r.v) for r in bars.groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("low"), F.sum("volume").alias("v")).collect()} == {(t, 29, date(2020, 1, 3), 203) for t in ("AAA", "BBB", "CCC")}
    assert [r.ticker for r in missing.collect()] == ["NONE"]
    assert asked() == ["AAA,BBB 2020-01-03 None", "CCC,NONE 2020-01-03 None"]
    assert bars.select(F.sum("adj_close")).first()[0] == bars.select(F.sum("close")).first()[0]
    asked()


def test_filters_reach_the_provider(read):
    load, asked = read
    some = load(group="1").where(F.col("ticker").isin("BBB", "CCC") & (F.col("date") > date(2020, 1, 9)) & (F.col("date") <= date(2020, 1, 11)) & (F.col("close") > 9))
    assert sorted((r.ticker, r.date.day) for r in some.collect()) == [("BBB", 11), ("CCC", 11)]
    assert asked() == ["BBB 2020-01-10 2020-01-12", "CCC 2020-01-10 2020-01-12"]
    assert load().where("ticker = 'ZZZ'").count() == 0 and load(tickers="").count() == 0


def test_failures_are_tried_again(read):
    load, asked = read
    assert load("shaky", group="1", tickers="AAA,BBB").count() == 62
    with pytest.raises(Exception, match="not now"):
        load("shaky", tickers="CCC", retries="0").count()
    asked()


def test_wide_tables():
    wide = pd.DataFrame({"date": ["2020-01-01", "2020-01-02"], "close|a": [1.0, None], "adj_close|a": [None, None], "close|b": [2.0, 3.0], "adj_close|b": [1.5, None]})
    got = [(str(r.date), r.ticker, r.adj_close) for r in provider.long_bars(wide).itertuples()]
    assert got == [("2020-01-01", "A", 1.0), ("2020-01-01", "B", 1.5), ("2020-01-02", "B", 3.0)]
