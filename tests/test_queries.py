"""Every registered retrieval query against its SQL on DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from foliary.jobs.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: ("z",) if v is None or (isinstance(v, float) and math.isnan(v)) else (repr(v),)
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    got = duck.execute(oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
