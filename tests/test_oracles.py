"""Every registered panel query against its DuckDB SQL on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from tidepanel.plans import model_queries, panel_queries, registry  # noqa: F401

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{TABLES}/{name}')")
    yield con
    con.close()


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(str([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", [n for n in registry.ORACLES if not n.startswith("backtest")])  # too few days here
def test_query_gives_what_its_sql_gives(spark, sql, name):
    got = registry.QUERIES[name](spark, TABLES)
    cursor = sql.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, cursor.fetchall())


def test_oracles_are_of_registered_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and all(isinstance(s, str) for s in registry.ORACLES.values())
