import duckdb
import pytest

import __spark_entry__ as entry
from causeway.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _text(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    sql = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    at = [sql.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(_text, r)) for r in df.collect()) == sorted(tuple(_text(r[i]) for i in at) for r in sql.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["var_i", "var_j", "value"] and df.count() == 10


def test_every_query_is_callable():
    assert set(entry.oracle_sql()) <= set(entry.queries())
