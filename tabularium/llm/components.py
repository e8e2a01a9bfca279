"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import materialize


def _mins(edges: DataFrame) -> DataFrame:
    """(u, m): each node's smallest neighbour. Written, as Spark splits a skewed join
    only between plain shuffles, and a hub's edges may be many."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long); root is the smallest node.

    Alternates large-star and small-star rounds until the edge set stays the same.
    A round joins each edge with its node's minimum, so no task ever holds a node's
    whole neighbourhood, and minima are combined before the shuffle. Each round is
    written to the shared folder, which ends its lineage. Null ends and loops are
    ignored; an empty edge list gives an empty result.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e)
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _mins(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        low = _mins(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
