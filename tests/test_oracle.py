"""Every checked query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.registry import TABLE_NAMES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
JOBS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql_twin(spark, duck, name):
    df = JOBS[name](spark, FOLDER)
    want = duck.execute(SQL[name])
    assert df.columns == [d[0] for d in want.description]
    assert _sorted(df.collect()) == _sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(JOBS) - set(SQL)))
def test_runs_without_twin(spark, name):
    assert JOBS[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(JOBS)
