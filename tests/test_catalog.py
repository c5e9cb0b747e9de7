"""Every engine query against DuckDB at the smallest scale."""

import math

import duckdb
import pytest

from exprloom.plans import catalog, reports

QUERIES, ORACLES = catalog.QUERIES | reports.QUERIES, catalog.ORACLES | reports.ORACLES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda v: ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_agrees_with_duckdb(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(want.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 821
    assert set(e.oracle_sql()) <= set(e.queries())
