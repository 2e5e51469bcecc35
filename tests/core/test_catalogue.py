"""Every query against its DuckDB SQL on the smallest tables."""

import math
from collections import Counter
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tempestry.plans import catalogue
from tempestry.plans.views import VIEWS, view, with_views

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (Decimal, int, float)) and not isinstance(v, bool):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cur = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(columns, cur.fetchall()) == rows(df.columns, df.collect())


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_views_are_the_same(spark, duck, name):
    df = view(spark, DATA, name)
    cur = duck.execute(with_views(f"SELECT * FROM {name}"))
    assert rows([d[0] for d in cur.description], cur.fetchall()) == rows(df.columns, df.collect())


def test_filters_reach_the_scan(spark):
    plan = view(spark, DATA, "track").where("storm_id = 3").select("fix_id")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(user_id,3)" in plan and "value" not in plan.split("ReadSchema")[1].split("\n")[0]
