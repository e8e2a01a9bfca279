from pyspark.sql import functions as F

from tabularium.streaming import tail


def test_windows_and_guard_over_files(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(3):
        src.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = tail.log_stream(spark, str(tmp_path / "log"), files_per_trigger=1)
    counts = {r.event_type: r.n for r in tail._run(tail.tail_counts(stream, -1), "complete").collect()}
    assert counts == {r.event_type: r["count"] for r in src.groupBy("event_type").count().collect()}
    windows = tail._run(tail.windowed_counts(stream, "1 day", "30 days"), "update")
    assert windows.agg(F.countDistinct("window.start")).first()[0] >= 1
    states = tail.replay_guard(spark, "/root/testdata/sf0.001/events.parquet").agg(F.sum("evals")).first()[0]
    assert states == src.count()
