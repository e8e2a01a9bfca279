"""Splits, chunk plans, batches and cursors."""

from pyspark.sql import functions as F

from tabularium.functions.hashing import context_key
from tabularium.operators import splits
from tabularium.queries import SPLIT_SQL, load, mix_ctes, query

TRAIN = f"train AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) AS ord FROM mixed WHERE {SPLIT_SQL} = 'train')"


@query(f"WITH r AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS row_index FROM events), {mix_ctes('r', 'row_index')} SELECT event_id, row_index, {SPLIT_SQL} AS split FROM mixed")
def row_split(spark, sf):
    return splits.row_split(load(spark, sf, "events").select("event_id"), ["event_id"])


@query(f"WITH {mix_ctes('lineitem', 'l_orderkey')} SELECT l_orderkey, l_linenumber, {SPLIT_SQL} AS split FROM mixed")
def context_split(spark, sf):
    return splits.context_split(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")


@query(f"WITH {mix_ctes('events', 'user_id')} SELECT CASE WHEN bucket < 20 THEN 'validation' WHEN bucket < 25 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT user_id) AS users FROM mixed GROUP BY 1")
def split_counts(spark, sf):
    t = splits.context_split(load(spark, sf, "events"), "user_id", validation=20, test=5)
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT 0::BIGINT AS leaking, count(DISTINCT conv_id) AS contexts FROM conversations")
def split_leak_check(spark, sf):
    t = splits.context_split(load(spark, sf, "conversations"), "conv_id")
    per = t.groupBy("conv_id").agg(F.count_distinct("split").alias("k"))
    return per.agg(F.count_if(F.col("k") > 1).alias("leaking"), F.count(F.lit(1)).alias("contexts"))


@query(f"WITH r AS (SELECT conv_id, (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS pos FROM conversations), {mix_ctes('r', 'conv_id')} SELECT {SPLIT_SQL} AS split, count(*) AS n, min(pos) AS first, max(pos) AS last FROM mixed GROUP BY 1")
def split_positions(spark, sf):
    return splits.positions_by_split(load(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], "conv_id")


def plan_sql(table: str, lower: int, upper: int, seed: int) -> str:
    return f"""WITH c AS (SELECT count(*) AS total FROM {table}), r AS (SELECT unnest(generate_series(0, total // {lower}))::BIGINT AS seq, total FROM c),
    k AS (SELECT *, xor(seq, {seed}::BIGINT) AS key FROM r), {mix_ctes('k', 'key')},
    p AS (SELECT seq, total, ({lower} + (mix % {upper - lower + 1})::BIGINT) AS p FROM mixed),
    s AS (SELECT seq, total, p, (sum(p) OVER (ORDER BY seq))::BIGINT AS upto FROM p),
    plan AS (SELECT seq, upto - p AS start, least(upto, total) AS stop, least(upto, total) - (upto - p) AS size FROM s WHERE upto - p < total)"""


@query(plan_sql("lineitem", 3072, 5120, 42) + " SELECT seq, start, stop, size FROM plan")
def chunk_plan(spark, sf):
    return splits.chunk_plan(spark, load(spark, sf, "lineitem").count())


@query(plan_sql("events", 384, 640, 7) + " SELECT count(*) AS chunk_count, min(size) AS minimum_records, max(size) AS maximum_records, sum(size)::BIGINT AS records FROM plan")
def chunk_summary(spark, sf):
    return splits.chunk_summary(splits.chunk_plan(spark, load(spark, sf, "events").count(), 512, 256, 768, 7))


@query(f"WITH {mix_ctes('events', 'user_id')}, {TRAIN} SELECT event_id, ord AS train_ordinal, ord // 64 AS batch_id FROM train")
def batch_assignment(spark, sf):
    t = splits.train_ordinals(load(spark, sf, "events").select("event_id", "user_id"), ["event_id"], "user_id")
    return splits.batches(t, 64).select("event_id", "train_ordinal", "batch_id")


@query(f"WITH {mix_ctes('events', 'user_id')}, {TRAIN}, n AS (SELECT count(*) AS n FROM train), e AS (SELECT ord, x.epoch, n FROM train, n, (VALUES (0), (1)) AS x(epoch)) SELECT (epoch * n + ord) // 100 AS batch_id, min(epoch)::INTEGER AS first_epoch, max(epoch)::INTEGER AS last_epoch, count(*) AS n FROM e GROUP BY 1")
def epoch_index(spark, sf):
    t = splits.train_ordinals(load(spark, sf, "events").select("event_id", "user_id"), ["event_id"], "user_id")
    return splits.batches(t, 100, epochs=2).groupBy("batch_id").agg(F.min("epoch").cast("int").alias("first_epoch"), F.max("epoch").cast("int").alias("last_epoch"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {mix_ctes('events', 'user_id')}, {TRAIN} SELECT event_id, ord AS train_ordinal, (ord - 200) // 50 AS batch_id FROM train WHERE ord >= 200")
def resume_cursor(spark, sf):
    t = splits.train_ordinals(load(spark, sf, "events").select("event_id", "user_id"), ["event_id"], "user_id")
    return splits.batches(t, 50, consumed=200).select("event_id", "train_ordinal", "batch_id")


@query(f"WITH {mix_ctes('events', 'user_id')}, h AS (SELECT event_id, {SPLIT_SQL} AS split FROM mixed) SELECT event_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY event_id) AS k FROM h WHERE split <> 'train') WHERE k <= 32")
def heldout_head(spark, sf):
    return splits.heldout_head(load(spark, sf, "events").select("event_id", "user_id"), ["event_id"], "user_id", 32).select("event_id", "split")


@query()
def text_context_split(spark, sf):
    """Contexts that are texts: blake2b has no SQL, so tests compare it with Python."""
    t = load(spark, sf, "documents").select("doc_id", "source", context_key(F.col("source")).alias("key"))
    return splits.context_split(t, "key").drop("key")
