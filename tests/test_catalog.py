"""Every query that has SQL gives the same rows as DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.catalog.SQL


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


def compare(spark, name, f, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{D}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, expected = f(spark, D).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, name, __spark_entry__.catalog.QUERIES[name], SQL[name])


def test_queries_without_sql_run(spark):
    for name in sorted(set(__spark_entry__.catalog.QUERIES) - set(SQL)):
        assert __spark_entry__.catalog.QUERIES[name](spark, D).count() > 0, name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
