"""Every query against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest
from conftest import SF

from peerlens.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLE_SQL:
        return
    result = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    want = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__

    assert set(ORACLE_SQL) <= set(QUERIES)
    assert __spark_entry__.entry(spark).columns[0] == "target"
    assert set(QUERIES) <= set(__spark_entry__.queries())
