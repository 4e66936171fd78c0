"""Every query with SQL gives the rows that DuckDB gives for its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    order = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in order) for r in df.collect()), key=str)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == order
    place = [names.index(c) for c in order]
    want = sorted((tuple(cell(r[i]) for i in place) for r in found.fetchall()), key=str)
    assert len(got) == len(want) > 0
    assert got == want


@pytest.mark.parametrize("name", ["metric_catalog", "metric_catalog_by_category", "metric_search"])
def test_rows_only(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
