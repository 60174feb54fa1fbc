"""Every registered query beside its SQL on the smallest tables."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest
from helpers import SMALL

import __spark_entry__ as entry
from tillroll.plans.oracle import ORACLE_SQL
from tillroll.plans.queries import QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import TYPES, rows_of  # noqa: E402

ROWS_ONLY = {"model_auc", "submission", "validation_curve"}


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for name in os.listdir(SMALL):
        out.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return out


def test_every_query_has_sql_but_the_models():
    assert set(QUERIES) - set(ORACLE_SQL) == ROWS_ONLY
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    want = db.sql(ORACLE_SQL[name])
    types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    assert types == dict(zip(want.columns, map(str, want.types)))
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 4363
