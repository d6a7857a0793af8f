"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from crucible import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def value(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return round(float(x), 5) + 0.0
    return x if isinstance(x, (str, bool, list)) else int(x) if hasattr(x, "__int__") else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(value(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, sf, db, name):
    got = plans.queries()[name](spark, sf)
    cursor = db.execute(plans.oracle_sql()[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert rows(got.columns, got.collect()) == want
    assert want[1]


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() > 0
