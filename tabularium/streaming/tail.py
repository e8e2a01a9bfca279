"""Tails of an event log as Structured Streaming queries.

The live forms (`tail_counts`, `guard_states`) are streams; the replays drive them over
a finite log with `availableNow` and a checkpoint in the shared folder, so that a batch
query can be compared with them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GUARD = "user_id long, evals long, best double, streak long"


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """New files of a folder, or the one file, as a stream; offsets live in the checkpoint."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", name == "").parquet(_stream_path(spark, path, folder, name))


def _stream_path(spark: SparkSession, path: str, folder: str, name: str) -> str:
    """A stream reads folders; a single file is named by a glob that matches it alone."""
    return path if not name.endswith(".parquet") else f"{folder}/{name[:-1]}[{name[-1]}]"


def tail_counts(events: DataFrame, last: int = 0) -> DataFrame:
    """Counts and sums by event type behind ``last``, over the whole stream."""
    return events.where(F.col("event_id") > last).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event type and tumbling window; rows later than the watermark are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def guard_states(events: DataFrame, margin: float = 0.03) -> DataFrame:
    """Per user the number of evaluations, the best score and the streak below it, kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        evals, best, streak = state.get if state.exists else (0, None, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for value in rows["value"]:
            streak = streak + 1 if best is not None and value < best - margin else 0
            best = value if best is None or value > best else best
            evals += 1
        state.update((evals, float(best), streak))
        yield pd.DataFrame({"user_id": [key[0]], "evals": [evals], "best": [best], "streak": [streak]})

    rows = events.select("user_id", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, GUARD, "evals long, best double, streak long", "update", GroupStateTimeout.NoTimeout)


def _folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; only a local session without it gets one of its own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tabularium-")
    return f"{root.rstrip('/')}/streams/{uuid.uuid4().hex}"


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is and gives its output, written as Parquet by batch.

    A batch that is run again after a failure replaces its own folder. "complete" gives
    the last batch, "update" all of them.
    """
    spark, schema, root = stream.sparkSession, stream.schema, _folder(stream.sparkSession)
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{number}")
        done.append(number)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], schema)
    batches = [max(done)] if mode == "complete" else sorted(set(done))
    return spark.read.schema(schema).parquet(*(f"{root}/out/{k}" for k in batches))


def replay(spark: SparkSession, path: str, last: int = 0) -> DataFrame:
    """``tail_counts`` over a finite log: a row per event type."""
    return _run(tail_counts(log_stream(spark, path), last), "complete")


def replay_guard(spark: SparkSession, path: str) -> DataFrame:
    """``guard_states`` over a finite log: the last state of each user."""
    states = _run(guard_states(log_stream(spark, path)), "update")
    last = lambda c: F.max_by(c, "evals")
    return states.groupBy("user_id").agg(F.max("evals").alias("evals"), F.round(last("best"), 9).alias("best"), last("streak").alias("streak"))
