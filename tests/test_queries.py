"""Every registered query of the series engine runs, and those with SQL agree with DuckDB."""

import math

import duckdb
import pytest

from convseries.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(SQL[name])
    want = table([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    differing = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert len(differing) <= len(want[1]) // 1000, differing[:3]  # the fifth decimal may round either way


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).collect()


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(math.isfinite(r.mean_max) and 0 < r.mean_ppv < 1 for r in rows)
