"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import os

import duckdb
import pytest

from loomline.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        return round(float(value), 9) + 0.0
    return int(value) if type(value).__name__.startswith(("int", "uint")) else value


def rows(frame):
    return sorted(map(repr, (tuple(plain(v) for v in r) for r in frame[sorted(frame)].astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert sorted(got) == sorted(want)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).limit(5).count() >= 0


def test_entry_is_dense(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    years = out.select("year").distinct().count()
    topics = out.select("source", "macro_topic", "topic").distinct().count()
    assert out.count() == years * topics
