"""Every query with a SQL twin gives the same rows as DuckDB on the small tables."""

import glob
import math
import os

import pytest

from cinderlake import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_twin(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    found = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, found.fetchall())
