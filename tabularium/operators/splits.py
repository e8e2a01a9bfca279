"""Splits, chunk plans, ordered batches and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.hashing import unsigned_mod, with_mix64, with_split
from tabularium.operators.order import with_ordinal


def row_split(df: DataFrame, order: list[str], name: str = "split") -> DataFrame:
    """Adds row_index (the place in the order) and the unseeded split of that index."""
    return with_split(with_ordinal(df, order, "row_index"), F.col("row_index"), name)


def context_split(df: DataFrame, key: str | Column, name: str = "split", validation: int = 15, test: int = 15) -> DataFrame:
    """Adds the split of a context, so that rows of one context never part."""
    return with_split(df, F.col(key) if isinstance(key, str) else key, name, validation, test)


def positions_by_split(df: DataFrame, order: list[str], key: str) -> DataFrame:
    """(split, n, first, last) of the input places of each split, whose order is kept."""
    placed = context_split(with_ordinal(df, order, "position"), key)
    return placed.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


def chunk_plan(spark: SparkSession, total: int, target: int = 4096, minimum: int = 3072, maximum: int = 5120, seed: int = 42) -> DataFrame:
    """(seq, start, stop, size): ranges of varying size that tile ``total`` records.

    A chunk's size is drawn from three to five quarters of the target, held within the
    limits, by a hash of the seed and its number; the last one takes what is left. The
    bounds are the running sum of the sizes, so there is no loop. The plan has a row
    per ``minimum`` records at most; it is a plan's size, not the data's.
    """
    if not 0 < minimum <= maximum or target <= 0 or total < 0:
        raise ValueError("0 < minimum <= maximum and 0 < target are asked for")
    lower = min(max(target * 3 // 4, minimum), maximum)
    upper = min(max(target * 5 // 4, lower), maximum)
    seqs = with_mix64(spark.range(max(1, -(-total // lower))).withColumnRenamed("id", "seq"), F.col("seq").bitwiseXOR(F.lit(seed)), "m")
    sized = seqs.select("seq", (F.lit(lower) + unsigned_mod(F.col("m"), upper - lower + 1)).alias("p"))
    stop = F.sum("p").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = sized.select("seq", (stop - F.col("p")).alias("start"), F.least(stop, F.lit(total)).alias("stop")).where(F.col("start") < total)
    return placed.select("seq", "start", "stop", (F.col("stop") - F.col("start")).alias("size"))


def chunk_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count(F.lit(1)).alias("chunk_count"), F.min("size").alias("minimum_records"), F.max("size").alias("maximum_records"), F.sum("size").alias("records"))


def train_ordinals(df: DataFrame, order: list[str], key: str) -> DataFrame:
    """The training rows with train_ordinal, their place among themselves."""
    return with_ordinal(context_split(df, key).where("split = 'train'").drop("split"), order, "train_ordinal")


def batches(ordered: DataFrame, size: int, epochs: int = 1, consumed: int = 0) -> DataFrame:
    """(…, epoch, position, batch_id): what a stream of batches gives from a cursor on.

    Epochs repeat the rows in the same order and batches run on over their ends. A
    cursor of ``consumed`` rows is a filter: position counts from the very start.
    """
    n = ordered.count()
    if not n:
        return ordered.withColumns({"epoch": F.lit(0), "position": F.lit(0).cast("long"), "batch_id": F.lit(0).cast("long")})
    out = ordered.withColumn("epoch", F.explode(F.sequence(F.lit(consumed // n), F.lit(consumed // n + epochs - 1))))
    out = out.withColumn("position", F.col("epoch") * F.lit(n).cast("long") + F.col("train_ordinal")).where(F.col("position") >= consumed)
    return out.withColumn("batch_id", F.floor((F.col("position") - F.lit(consumed)) / size).cast("long"))


def heldout_head(df: DataFrame, order: list[str], key: str, rows: int = 4096) -> DataFrame:
    """The first ``rows`` rows of validation and of test, in order.

    Each task keeps its own first rows before they meet (a limit per split), so the
    final window sees ``rows`` rows a task at most.
    """
    parts = []
    for name in ("validation", "test"):
        parts.append(context_split(df, key).where(F.col("split") == name).orderBy(*order).limit(rows))
    return parts[0].unionByName(parts[1])
