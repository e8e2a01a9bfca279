"""Catalogue queries over append-only tables of versions and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, key: str, updated: str, deleted: str | None = None) -> DataFrame:
    """The last version of each key; keys whose last version is a tombstone are left out.

    A maximum of structs: it is combined before the shuffle, so a key with many
    versions is no hot task.
    """
    order = F.struct(updated, F.struct(*(c for c in versions.columns if c != updated)))
    out = versions.groupBy(key).agg(F.max(order).alias("__v"))
    out = out.select(*(F.col(f"__v.{updated}") if c == updated else F.col(f"__v.col2.{c}").alias(c) for c in versions.columns))
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def recent(log: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The last ``n`` rows, 1 to 1000."""
    return log.orderBy(F.desc(order)).limit(max(1, min(1000, n)))


def since(log: DataFrame, last: int, n: int = 100, order: str = "id") -> DataFrame:
    """The next rows behind ``last``, oldest first."""
    return log.where(F.col(order) > last).orderBy(order).limit(n)


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """A page of a total order: 1 to 500 rows from a place that isn't negative."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(500, limit)))


def queue_order(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "low", 2).otherwise(1)


def orphans(files: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Files without a record."""
    return files.join(records.select(key).distinct(), key, "left_anti")


def reuse(items: DataFrame, digest: str, target: str, key: str) -> DataFrame:
    """(…, first): the first item with the same content and target; items that are it may be reused."""
    first = items.groupBy(digest, target).agg(F.min(key).alias("first"))
    return items.join(first, [digest, target])


def trace_tail(events: DataFrame, at: str, key: str, n: int = 128) -> DataFrame:
    """The last ``n`` events, as a ring buffer holds them."""
    return events.orderBy(F.desc(at), F.desc(key)).limit(n)


def usage(runs: DataFrame, live: Column) -> DataFrame:
    return runs.where(live).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cpu", "ram", "gpu")))


def set_union(df: DataFrame, arrays: list[str]) -> DataFrame:
    """For each array column the sorted distinct values of all rows."""
    return df.agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in arrays))


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first in the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
