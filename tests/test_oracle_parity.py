"""Every registered query equals its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as entry

SOURCE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
from ledgerline.oracle import ORACLE
from ledgerline.registry import QUERIES

QUERY_NAMES = list(QUERIES)


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _canon(records, cols):
    out = [tuple(_norm(r[c]) for c in cols) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in SOURCE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    got = [r.asDict() for r in df.collect()]
    rel = duck.sql(entry.oracle_sql()[name])
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert sorted(df.columns) == sorted(rel.columns)
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for col, t in df.dtypes:
        assert SPARK_TO_DUCK.get(t, t.upper()) == duck_types[col], (col, t, duck_types[col])
    assert len(got) == len(want)
    cols = sorted(df.columns)
    assert _canon(got, cols) == _canon(want, cols)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    first = df.schema
    assert df.count() > 0
    assert entry.entry(spark).schema == first
    assert df.columns == ["product_a", "product_b", "recommendation_score", "rn"]
