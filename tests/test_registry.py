"""Every query of the engine against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from helixframe import registry, registry_files

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


QUERIES = registry.QUERIES | registry_files.QUERIES
SQL = registry.ORACLE_SQL | registry_files.ORACLE_SQL


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*[f"`{c}`" for c in names]).collect()]
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(map(plain, r)) for r in rows), key=key) == sorted((tuple(map(plain, r)) for r in want), key=key)
    assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
