"""Every registered query of the engine against its SQL, and the entry point."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from tabularium.queries import ORACLE_SQL, QUERIES
from tabularium.queries.profiles import TABLES

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLE_SQL[name])
    columns, kinds = [d[0] for d in got.description], {d[0]: str(d[1]) for d in got.description}
    assert sorted(columns) == sorted(df.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    order = sorted(columns)
    ours = sorted([tuple(value(r[c]) for c in order) for r in df.collect()], key=str)
    theirs = sorted([tuple(value(r[columns.index(c)]) for c in order) for r in got.fetchall()], key=str)
    assert ours == theirs


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "validation", "test"}


def test_registry():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries())
