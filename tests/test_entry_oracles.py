"""Driver contract: entry() runs, and every query agrees with its DuckDB oracle."""

import datetime
import decimal
import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
# Text operators are an optional part with tests of their own.
CORE = sorted(k for k in E.oracle_sql() if k not in E.LLM_QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns[0] == "site_id" and "binding_constraint" in df.columns


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()[:10]
    return v


def _digest(rows, cols, order):
    idx = [cols.index(c) for c in order]
    keyed = sorted(repr(tuple(_norm(r[i]) for i in idx)) for r in rows)
    return hashlib.sha1("\n".join(keyed).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(E.queries()) - set(E.LLM_QUERIES) == set(CORE)


@pytest.mark.parametrize("name", CORE)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [c[0] for c in res.description]
    orows = res.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    order = sorted(ocols)
    assert len(srows) == len(orows)
    assert _digest(srows, sdf.columns, order) == _digest(orows, ocols, order)
