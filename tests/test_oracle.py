"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


def _names():
    from siltworks.plans import catalogue

    return sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query(spark, sql, name):
    from siltworks.plans import catalogue

    df = catalogue.queries()[name](spark, SF)
    result = sql.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _canon([tuple(r) for r in df.collect()], df.columns) == _canon(result.fetchall(), columns)
