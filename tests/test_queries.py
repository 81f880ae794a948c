"""Every registered query with SQL gives the same rows as that SQL."""

import os

import duckdb
import pytest

from tracewright.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(0.0 if isinstance(r[i], float) and r[i] == 0 else r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf_dir, name):
    ours = catalog.queries()[name](spark, sf_dir)
    theirs = duck.sql(ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.collect(), ours.columns) == rows(theirs.fetchall(), theirs.columns)


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - ORACLES.keys()))
def test_without_sql_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).limit(5).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 15
