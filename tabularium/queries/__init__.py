"""The engine's operators as named queries over the test tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its own name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix_ctes(source: str, key: str, name: str = "mixed") -> str:
    """CTEs that add ``bucket``, the SplitMix64 of a key modulo 100, to a source."""
    m = "18446744073709551616::UHUGEINT"
    return f"""
        m0 AS (SELECT *, (({key}::UHUGEINT + 11400714819323198485::UHUGEINT) % {m})::UBIGINT AS v0 FROM {source}),
        m1 AS (SELECT *, ((xor(v0, v0 >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {m})::UBIGINT AS v1 FROM m0),
        m2 AS (SELECT *, ((xor(v1, v1 >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {m})::UBIGINT AS v2 FROM m1),
        {name} AS (SELECT * EXCLUDE (v0, v1, v2), xor(v2, v2 >> 31) AS mix, (xor(v2, v2 >> 31) % 100)::INTEGER AS bucket FROM m2)"""


SPLIT_SQL = "CASE WHEN bucket < 15 THEN 'validation' WHEN bucket < 30 THEN 'test' ELSE 'train' END"

from tabularium.queries import control, models, profiles, splitting, texts  # noqa: E402, F401
