"""Every query with SQL against DuckDB on the smallest tables; the others must run (tests/test_brute_force.py and others hold their operators against definitions)."""

import os

import duckdb
import pytest

from axonlake.plans import catalog, catalog_extra, catalog_reports  # noqa: F401

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in (r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE])
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = duck.execute(catalog.ORACLE[name])
    names = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(got.fetchall(), names)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE])
def test_runs(spark, name):
    catalog.QUERIES[name](spark, DIR).collect()
