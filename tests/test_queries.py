"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from noticeforge.bindings_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, int)) and not isinstance(v, bool) or type(v).__name__ == "Decimal":
        return round(float(v), 4)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(plain(r[c]) for c in columns) for r in df.collect()) == key(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_flagship_counts(spark):
    got = {r.report_group: r["count"] for r in QUERIES["report_daily"](spark, SF).groupBy("report_group").count().collect()}
    assert got == {"to_confirm": 502, "closing_soon": 2, "priority": 154}


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
