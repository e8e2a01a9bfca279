import time

import duckdb
import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabularium.functions import hashing, numbers
from tabularium.operators import guard, metrics, order, prepare, profile, splits
from tabularium.queries import ORACLE_SQL, QUERIES

MASK = (1 << 64) - 1


def mix(k: int) -> int:
    v = (k + hashing.GAMMA) & MASK
    v = ((v ^ (v >> 30)) * hashing.MIX1) & MASK
    v = ((v ^ (v >> 27)) * hashing.MIX2) & MASK
    return v ^ (v >> 31)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=40))
def test_mix_equals_unsigned_arithmetic(spark, keys):
    rows = hashing.with_mix64(spark.createDataFrame([(k,) for k in keys], "k long"), F.col("k"), "m").collect()
    assert [r.m & MASK for r in rows] == [mix(r.k & MASK) for r in rows]


def test_first_splits(spark):
    got = [r.split for r in hashing.with_split(spark.range(6), F.col("id")).orderBy("id").collect()]
    assert got == ["train", "train", "validation", "train", "train", "test"]


def test_split_filter_keeps_the_plan_small(spark):
    df = hashing.with_split(spark.range(10), F.col("id")).where("split = 'train'")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 50_000


def test_feature_buckets(spark):
    df = spark.createDataFrame([("N",), ("R",), ("A",), (None,)], "v string")
    assert {r.value: r.bucket for r in hashing.feature_buckets(df, "v").collect()} == {"N": 18, "R": 63, "A": 26}


def test_chunks_tile_all_records(spark):
    for total in (0, 1, 511, 19_999, 60_000):
        rows = splits.chunk_plan(spark, total).orderBy("seq").collect()
        ends = [0, *(r.stop for r in rows)]
        assert [r.start for r in rows] == ends[:-1]
        assert ends[-1] == total
    assert [r.size for r in rows] == [4300, 3097, 3979, 3843, 3696, 4455, 4995, 5044, 3962, 4002, 4705, 4080, 3819, 3605, 2418]


def test_ordinal_equals_a_flat_window(spark):
    df = spark.range(997).select((F.col("id") * 37 % 997).alias("k"), F.lit(2).alias("n"))
    assert all(r.ordinal == r.k for r in order.with_ordinal(df, ["k"], buckets=7).collect())
    assert all(r.s == 2 * (r.k + 1) for r in order.with_running_sum(df, ["k"], "n", "s", buckets=7).collect())
    assert order.with_ordinal(df.where("k < 0"), ["k"]).count() == 0


def test_restore_is_a_filter(spark):
    df = spark.range(50).select("id", F.col("id").alias("train_ordinal"))
    whole = [r.id for r in splits.batches(df, 7, epochs=2).orderBy("position").collect()]
    rest = [r.id for r in splits.batches(df, 7, epochs=2, consumed=60).orderBy("position").collect()]
    assert whole == [*range(50)] * 2
    assert rest[:40] == whole[60:]


def test_auc_ties_and_empty_classes(spark):
    auc = lambda rows: metrics.roc_auc(spark.createDataFrame(rows, "truth int, p double")).first()["auc"]
    assert auc([(0, 0.5), (1, 0.5)]) == 0.5
    assert auc([(0, 0.1), (1, 0.9), (0, 0.2)]) == 1.0
    assert auc([(1, 0.5)]) is None


def test_hysteresis_and_streak(spark):
    rows = [(1, k, s) for k, s in enumerate([0.5, 0.6, 0.55, 0.61, 0.3, 0.3])]
    r = guard.controller(spark.createDataFrame(rows, "run int, step int, score double"), "run", "step", "score").first()
    assert (r.best, r.best_step, r.streak, r.reason) == (0.61, 3, 2, None)


def test_steps_end_a_run_only_where_a_limit_is_named(spark):
    rows = spark.createDataFrame([(1, 999_999, 0.1), (1, 1_000_000, 0.2), (1, 6_000_000_000, 0.3)], "run int, step long, score double")
    free = guard.controller(rows, "run", "step", "score").first()
    assert (free.best_step, free.evals, free.reason, free.stop_step) == (6_000_000_000, 3, None, None)
    bound = guard.controller(rows, "run", "step", "score", guard.Policy(max_steps=1_000_000)).first()
    assert (bound.best_step, bound.evals, bound.reason, bound.stop_step) == (1_000_000, 2, "max_steps", 1_000_000)


def test_controller_query_equals_sql_past_a_million(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_id", F.col("event_id") + 999_500)
    events.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = QUERIES["controller_fold"](spark, str(tmp_path))
    got = con.execute(ORACLE_SQL["controller_fold"])
    columns = [d[0] for d in got.description]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(got.fetchall(), key=str)


def test_rate_limit_ignores_rejected_hits(spark):
    hits = spark.createDataFrame([(1, float(t)) for t in (0, 1, 2, 3, 61, 62)], "b int, t double")
    got = {r.seconds: r.allowed for r in guard.rate_limit(hits, "b", "t", 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 61: True, 62: True}


def brute_passing(times, most, window):
    live, out = [], []
    for x in times:
        live = [t for t in live if t > x - window]
        out.append(len(live) < most)
        live += [x] if out[-1] else []
    return out


def test_rate_limit_equals_brute_force(spark):
    """Buckets that end inside and at the ends of batches, equal times, and none at all."""
    rng = np.random.default_rng(3)
    times = {b: sorted(rng.integers(0, span, n).astype(float).tolist()) for b, span, n in [(0, 900, 40), (1, 90, 400), (2, 9000, 100), (3, 10, 1), (None, 500, 60), (5, 5, 130)]}
    hits = spark.createDataFrame([(b, t) for b, ts in times.items() for t in ts] + [(3, None), (3, None)], "b int, t double")
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "20")
    try:
        for most, window in ((1, 60), (3, 60), (7, 25), (0, 60)):
            got = {}
            for r in guard.rate_limit(hits, "b", "t", most, window).collect():
                got.setdefault(r.b, []).append((r.seconds is None, r.seconds or 0.0, r.allowed))
            assert [x[2] for x in got[3] if x[0]] == [most > 0] * 2
            for b, ts in times.items():
                mine = sorted(x[1:] for x in got[b] if not x[0])
                assert mine == sorted(zip(ts, brute_passing(ts, most, window), strict=True))
    finally:
        spark.conf.set(key, old)


def test_rate_limit_of_a_busy_bucket(spark):
    """Two hundred thousand hits of one bucket that all pass: time must not grow with their square."""
    hits = spark.range(200_000).select(F.lit(1).alias("b"), (F.col("id") * 100.0).alias("t"))
    begun = time.monotonic()
    assert guard.rate_limit(hits, "b", "t", 2).where("allowed").count() == 200_000
    assert time.monotonic() - begun < 60


def test_task_rules(spark):
    def task(values, stream=False):
        df = spark.createDataFrame([(str(v),) for v in values], "y string")
        return profile.target_task(df, "y", stream).first().task

    assert task([0, 1] * 50) == "binary_classification"
    assert task([k % 3 for k in range(100)]) == "multiclass_classification"
    assert task([k % 21 for k in range(100)]) == "regression"
    assert task([k / 7 for k in range(100)]) == "regression"
    assert task([f"c{k}" for k in range(65)]) == "error"
    assert task([5] * 50) == "regression"
    assert task([5] * 50, stream=True) == "multiclass_classification"


def test_blank_targets_are_dropped_and_counted(spark):
    rows = [(str(k), "" if k % 5 == 0 else "ab"[k % 2]) for k in range(100)]
    enc = prepare.fit_encoder(spark.createDataFrame(rows, "x string, y string"), "y")
    assert (enc.rows, enc.skipped, enc.classes) == (80, 20, ["a", "b"])


def test_zero_stays_zero(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "x int")
    assert [r[0] for r in df.select(numbers.parse_number(F.col("x"))).collect()] == [0.0, 1.0, None]


def test_hashed_categories_of_a_stream(spark):
    rows = [(str(k % 3), f"name{k}", str(k % 2)) for k in range(100)]
    enc = prepare.fit_encoder(spark.createDataFrame(rows, "n string, c string, y string"), "y", stream=True)
    out = enc.transform(spark.createDataFrame(rows, "n string, c string, y string")).first()
    assert [f.kind for f in enc.features] == ["standardize", "feature_hash"]
    assert len(out.features) == 65 and sum(out.features[1:]) == 1.0


def test_exact_medians_even_when_narrowed(spark, monkeypatch):
    import statistics

    from tabularium.operators import quantiles

    rows = [(float(k * 7919 % 4001), float(k % 3), None if k % 2 else float(k)) for k in range(4001)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = [statistics.median(v for v in c if v is not None) for c in zip(*rows, strict=True)]
    for most in (500_000, 40):
        monkeypatch.setattr(quantiles, "MOST", most)
        monkeypatch.setattr(quantiles, "HALF", 0.1 if most == 40 else 5e-4)
        got = prepare.numeric_stats(df, ["a", "b", "c"]).collect()
        assert [r.median for r in got] == want
    assert prepare.numeric_stats(df.where("a < 0"), ["a"]).first().median is None


def test_quick_profile_equals_the_exact_one(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_returnflag", "l_linenumber", "l_quantity")
    exact = {r.column_name: r.asDict() for r in profile.column_profile(df).collect()}
    quick = profile.quick_profile(df, df.columns)
    assert all(exact[c][k] == v for c, p in quick.items() for k, v in p.items())


def test_more_classes_than_kept_are_an_error(spark, monkeypatch):
    import pytest

    rows = spark.createDataFrame([(str(k * 0.5), "ab"[k % 2]) for k in range(40)], "x string, y string")
    assert prepare.fit_encoder(rows, "y").classes == ["a", "b"]
    monkeypatch.setattr(prepare, "MAX_CATEGORIES", 0)
    with pytest.raises(ValueError, match="more than 0 classes"):
        prepare.fit_encoder(rows, "y")
