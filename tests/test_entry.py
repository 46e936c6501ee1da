"""Driver contract: entry smoke, registry consistency, and a DuckDB oracle
comparison of a sample of queries on the sf0.001 tables."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from panelkit.sources.readers import TABLES
from tests.conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"yr", "tier", "n", "total", "pct"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_matches_duckdb(spark, con, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    s = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    idx = [dcols.index(c) for c in cols]
    d = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert s == d
