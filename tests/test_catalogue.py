"""Every query that SQL can express gives DuckDB's rows; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarrystone.plans.bank_queries import ORACLES, QUERIES
from quarrystone.sources.tables import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=str)
        assert rows == want
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())
