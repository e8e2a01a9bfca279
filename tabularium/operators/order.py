"""Ordinals and running sums over a whole table without a one-task window.

Rows are dealt to buckets by quantiles of the leading sort column; each bucket is
numbered by its own window and shifted by the totals of the buckets before it. Only
one total per bucket reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def _bucketed(df: DataFrame, lead: str, buckets: int) -> DataFrame:
    key = F.col(lead).cast("double")
    cuts = df.agg(F.percentile_approx(key, [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    edges = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    return df.withColumn("__bucket", F.size(F.filter(edges, lambda e: e < key)))


def _offsets(rows: list, places: int) -> Column:
    sums = {r[0]: r[1] or 0 for r in rows}
    out, total = [], 0
    for k in range(places):
        out.append(total)
        total += sums.get(k, 0)
    return F.array(*map(F.lit, out))


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal", buckets: int = BUCKETS) -> DataFrame:
    """Adds each row's place, from 0, in the order of ``order``; its first column is a number or time."""
    df = _bucketed(df, order[0], buckets)
    offset = _offsets(df.groupBy("__bucket").count().collect(), buckets + 1)
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1 + F.get(offset, F.col("__bucket"))
    return df.withColumn(name, place.cast("long")).drop("__bucket")


def with_running_sum(df: DataFrame, order: list[str], value: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds the sum of ``value`` (a whole number) over all rows up to and with this one."""
    df = _bucketed(df, order[0], buckets)
    offset = _offsets(df.groupBy("__bucket").agg(F.sum(F.col(value).cast("long"))).collect(), buckets + 1)
    window = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, (F.sum(F.col(value).cast("long")).over(window) + F.get(offset, F.col("__bucket"))).cast("long")).drop("__bucket")
