"""Guards, planners and catalogue queries."""

from pyspark.sql import functions as F

from tabularium.operators import catalog, guard, planners
from tabularium.operators.metrics import share_of_weights
from tabularium.operators.order import with_ordinal
from tabularium.queries import load, query

EVALS = "SELECT user_id AS run, event_id AS step, least(1, greatest(0, value / 100))::DOUBLE AS score FROM events"


def evaluations(spark, sf):
    t = load(spark, sf, "events")
    return t.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("score"))


def controller_sql(p: guard.Policy) -> str:
    better = f"(best IS NULL OR score > best + {p.min_improvement}::DOUBLE)"
    worse = f"(best IS NOT NULL AND score < best - {p.margin}::DOUBLE)"
    return f"""WITH RECURSIVE e AS ({EVALS}), o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM e),
    f AS (SELECT run, 0::BIGINT AS k, NULL::DOUBLE AS best, NULL::BIGINT AS best_step, 0 AS streak, 0 AS plateau, 0 AS hits, 0 AS evals, NULL::VARCHAR AS reason, NULL::BIGINT AS stop_step FROM (SELECT DISTINCT run FROM o)
      UNION ALL
      SELECT run, k, best, best_step, streak, plateau, hits, evals,
        CASE WHEN streak >= {p.degradation_patience} THEN 'model_degradation' WHEN hits >= {p.target_patience} THEN 'target_reached' WHEN plateau > {p.plateau_patience} THEN 'early_stopping' END,
        CASE WHEN streak >= {p.degradation_patience} OR hits >= {p.target_patience} OR plateau > {p.plateau_patience} THEN step END
      FROM (SELECT f.run, o.k, o.step, CASE WHEN {better} THEN score ELSE best END AS best, CASE WHEN {better} THEN o.step ELSE best_step END AS best_step, CASE WHEN {worse} THEN streak + 1 ELSE 0 END AS streak,
            CASE WHEN {better} THEN 0 ELSE plateau + 1 END AS plateau, CASE WHEN score >= {p.target}::DOUBLE THEN hits + 1 ELSE 0 END AS hits, evals + 1 AS evals FROM f JOIN o ON o.run = f.run AND o.k = f.k + 1 WHERE f.reason IS NULL))
    SELECT run, round(best, 9) AS best, best_step, streak, plateau, hits, evals, reason, stop_step FROM f QUALIFY row_number() OVER (PARTITION BY run ORDER BY k DESC) = 1"""


POLICY = guard.Policy(margin=0.2, degradation_patience=4, plateau_patience=6, target_patience=2, target=0.5)


@query(controller_sql(POLICY))
def controller_fold(spark, sf):
    return guard.controller(evaluations(spark, sf), "run", "step", "score", POLICY).withColumn("best", F.round("best", 9))


@query(f"""WITH RECURSIVE e AS ({EVALS}), o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM e),
    f AS (SELECT run, 0::BIGINT AS n, NULL::DOUBLE AS p1, NULL::DOUBLE AS p2, 32 AS batch, 0 AS adjustments FROM (SELECT DISTINCT run FROM o)
      UNION ALL
      SELECT run, n + 1, score, p1, CASE WHEN down THEN greatest(4, batch // 2) WHEN up THEN least(128, batch * 2) ELSE batch END, adjustments + CASE WHEN down OR up THEN 1 ELSE 0 END
      FROM (SELECT f.*, o.score, (n >= 2 AND score < greatest(p1, p2) - 0.04::DOUBLE AND batch > 4) AS down, (n IN (1, 3) AND abs(score - p1) <= 0.02::DOUBLE AND batch < 128) AS up FROM f JOIN o ON o.run = f.run AND o.k = f.n + 1))
    SELECT run, batch, adjustments FROM f QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC) = 1""")
def batch_adaptation(spark, sf):
    return guard.adapt_batch(evaluations(spark, sf), "run", "step", "score", 32, 4, 128, 10_000)


@query(f"""WITH e AS ({EVALS}), b AS (SELECT run, step, CASE WHEN step % 97 = 0 THEN 'nan'::DOUBLE ELSE score END AS score, 0.6::DOUBLE AS best FROM e)
    SELECT run, step, CASE WHEN isnan(score) THEN 'invalid' WHEN greatest(0, best - score) > 0.03::DOUBLE THEN 'regressing' ELSE 'stable' END AS status, NOT isnan(score) AS finite,
    CASE WHEN NOT isnan(score) THEN round(greatest(0, best - score), 9) END AS best_gap, CASE WHEN NOT isnan(score) THEN round(greatest(0, 0.4::DOUBLE - score), 9) END AS baseline_gap FROM b""")
def quality_gate(spark, sf):
    t = evaluations(spark, sf).withColumn("score", F.when(F.col("step") % 97 == 0, float("nan")).otherwise(F.col("score")))
    g = t.select("run", "step", guard.quality_gate(F.col("score"), F.lit(0.1), F.lit(0.6), 0.03, F.lit(0.4)).alias("g")).select("run", "step", "g.*")
    return g.withColumns({c: F.round(c, 9) for c in ("best_gap", "baseline_gap")})


@query("""WITH m AS (SELECT event_id, value, CASE WHEN event_id % 5 = 0 THEN 'inf'::DOUBLE ELSE value END AS a, CASE WHEN event_id % 3 = 0 THEN 'nan'::DOUBLE ELSE 1 END AS b FROM events)
    SELECT event_id, array_to_string(list_filter([CASE WHEN isinf(a) THEN 'a' END, CASE WHEN isnan(b) THEN 'b' END], lambda x: x IS NOT NULL), ',') AS paths FROM m""")
def non_finite_paths(spark, sf):
    t = load(spark, sf, "events")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    m = F.create_map(F.lit("b"), F.when(F.col("event_id") % 3 == 0, nan).otherwise(1.0), F.lit("a"), F.when(F.col("event_id") % 5 == 0, inf).otherwise(F.col("value")))
    return t.select("event_id", F.array_join(guard.non_finite_paths(m), ",").alias("paths"))


@query("""WITH RECURSIVE h AS (SELECT user_id % 20 AS bucket, epoch(ts) AS s, event_id FROM events), o AS (SELECT bucket, s, row_number() OVER (PARTITION BY bucket ORDER BY s) AS k FROM h),
    f AS (SELECT bucket, 0::BIGINT AS k, []::DOUBLE[] AS live, NULL::DOUBLE AS s, NULL::BOOLEAN AS ok FROM (SELECT DISTINCT bucket FROM o)
      UNION ALL SELECT f.bucket, o.k, CASE WHEN len(list_filter(live, lambda t: t > o.s - 36000)) < 3 THEN list_append(list_filter(live, lambda t: t > o.s - 36000), o.s) ELSE list_filter(live, lambda t: t > o.s - 36000) END, o.s, len(list_filter(live, lambda t: t > o.s - 36000)) < 3
      FROM f JOIN o ON o.bucket = f.bucket AND o.k = f.k + 1)
    SELECT bucket, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS rejected FROM f WHERE k > 0 GROUP BY 1""")
def rate_limit(spark, sf):
    t = load(spark, sf, "events").select((F.col("user_id") % 20).alias("bucket"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("s")).withColumn("s", F.col("s") / 1e6)
    return guard.rate_limit(t, "bucket", "s", 3, 36000).groupBy("bucket").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("rejected"))


QUEUE = "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' ELSE 'low' END AS priority, s_suppkey AS created_at, (s_nationkey % 7 + 5)::BIGINT AS cpu, (s_nationkey % 5 + 4)::BIGINT AS ram, (s_nationkey % 3)::BIGINT AS gpu, s_nationkey AS host, s_acctbal AS credit FROM supplier"


def requests(spark, sf):
    k = F.col("s_suppkey")
    t = load(spark, sf, "supplier")
    n = F.col("s_nationkey")
    return t.select(k.alias("id"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "normal").otherwise("low").alias("priority"), k.alias("created_at"), (n % 7 + 5).cast("long").alias("cpu"), (n % 5 + 4).cast("long").alias("ram"), (n % 3).cast("long").alias("gpu"), n.alias("host"), F.col("s_acctbal").alias("credit"))


@query(f"""WITH RECURSIVE q AS ({QUEUE}), o AS (SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, created_at) AS k FROM q),
    f AS (SELECT 0::BIGINT AS k, 0::BIGINT AS c, 0::BIGINT AS r, 0::BIGINT AS g, NULL::BIGINT AS id, false AS admitted
      UNION ALL SELECT o.k, CASE WHEN ok THEN c + cpu ELSE c END, CASE WHEN ok THEN r + ram ELSE r END, CASE WHEN ok THEN g + gpu ELSE g END, o.id, ok FROM (SELECT f.c, f.r, f.g, o.*, (c + cpu <= 100 AND r + ram <= 100 AND g + gpu <= 100) AS ok FROM f JOIN o ON o.k = f.k + 1) o)
    SELECT id, admitted FROM f WHERE id IS NOT NULL""")
def admission(spark, sf):
    return guard.admission(requests(spark, sf)).select("id", "admitted")


# Weights are whole hundredths, so that their sums are exact in any order.
@query(f"SELECT id, greatest(5, round_even(100 * w / sum(w) OVER (PARTITION BY host), 0)::INTEGER) AS gpu FROM (SELECT id, host, CASE priority WHEN 'high' THEN 150::DOUBLE WHEN 'low' THEN 65 ELSE 100 END AS w FROM ({QUEUE}))")
def weighted_share(spark, sf):
    w = F.when(F.col("priority") == "high", 150.0).when(F.col("priority") == "low", 65.0).otherwise(100.0)
    return requests(spark, sf).select("id", share_of_weights(w, "host").alias("gpu"))


@query(f"SELECT id, priority, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, created_at)::BIGINT AS place FROM ({QUEUE})")
def priority_order(spark, sf):
    t = requests(spark, sf).withColumn("turn", catalog.queue_order(F.col("priority")))
    return with_ordinal(t, ["turn", "created_at"], "place").select("id", "priority", (F.col("place") + 1).alias("place"))


@query(f"SELECT sum(cpu)::BIGINT AS cpu, sum(ram)::BIGINT AS ram, sum(gpu)::BIGINT AS gpu FROM ({QUEUE}) WHERE credit > 0")
def resource_usage(spark, sf):
    return catalog.usage(requests(spark, sf), F.col("credit") > 0)


STATES = ["draft", "queued", "training", "pausing", "paused", "stopping", "stopped", "completed", "error_recoverable", "error"]
_V = ", ".join(f"('{s}')" for s in STATES)


@query(f"""SELECT c AS command, s AS status, CASE c WHEN 'start' THEN CASE WHEN s IN ('draft', 'queued') THEN 'queued' WHEN s = 'training' THEN s END
    WHEN 'resume' THEN CASE WHEN s IN ('paused', 'stopped', 'error_recoverable') THEN 'queued' END
    WHEN 'pause' THEN CASE WHEN s IN ('queued', 'paused') THEN 'paused' WHEN s IN ('training', 'pausing') THEN 'pausing' END
    ELSE CASE WHEN s IN ('draft', 'queued', 'paused', 'error_recoverable', 'stopped') THEN 'stopped' WHEN s IN ('training', 'pausing', 'stopping') THEN 'stopping' END END AS next,
    CASE WHEN s IN ('queued', 'training', 'pausing', 'stopping') THEN 'error_recoverable' ELSE s END AS recovered FROM (VALUES ('start'), ('resume'), ('pause'), ('stop')) AS a(c), (VALUES {_V}) AS b(s)""")
def state_transitions(spark, sf):
    t = spark.createDataFrame([(c, s) for c in guard.TRANSITIONS for s in STATES], "command string, status string")
    return t.select("command", "status", guard.transition(F.col("command"), F.col("status")).alias("next"), guard.recover(F.col("status")).alias("recovered"))


GRID = "SELECT r AS records, f AS features, p AS profile, g AS ram_gb FROM (VALUES (40), (300), (1500), (12000), (90000), (2000000)) AS a(r), (VALUES (4), (600), (5000)) AS b(f), (VALUES ('eco'), ('low-memory'), ('balanced'), ('custom'), ('performance'), ('workstation')) AS c(p), (VALUES (2), (16), (128)) AS d(g)"
_P2 = "pow(2, floor(log2(greatest(2, {})::DOUBLE) + 1e-12::DOUBLE))::BIGINT"


def grid(spark):
    rows = [(r, f, p, g) for r in (40, 300, 1500, 12000, 90000, 2000000) for f in (4, 600, 5000) for p in ("eco", "low-memory", "balanced", "custom", "performance", "workstation") for g in (2, 16, 128)]
    return spark.createDataFrame(rows, "records long, features long, profile string, ram_gb int")


@query(f"""WITH g AS ({GRID}), a AS (SELECT *, greatest(2, records - least(480, greatest(32, records // 5))) AS train, greatest(1, ram_gb)::DOUBLE * 1073741824 AS total FROM g),
    b AS (SELECT *, CASE WHEN train < 64 THEN 4 WHEN train < 256 THEN 8 WHEN train < 1024 THEN 16 WHEN train < 10000 THEN 32 WHEN train < 100000 THEN 64 ELSE 128 END AS base0,
      greatest(268435456::DOUBLE, least(total * 0.5::DOUBLE, total - CASE WHEN profile = 'workstation' THEN greatest(2147483648::DOUBLE, total * 0.05::DOUBLE) ELSE 0 END) * CASE WHEN profile = 'workstation' THEN 0.8::DOUBLE ELSE 0.35 END) AS usable FROM a),
    c AS (SELECT *, CASE WHEN features > 4096 THEN greatest(2, base0 // 4) WHEN features > 512 THEN greatest(2, base0 // 2) ELSE base0 END AS base,
      greatest(2, least(CASE profile WHEN 'eco' THEN 64 WHEN 'low-memory' THEN 64 WHEN 'performance' THEN 512 WHEN 'workstation' THEN 65536 ELSE 256 END, {_P2.format('floor(usable / greatest(2048, features * 48))::BIGINT')}, {_P2.format('train // 2')}))::BIGINT AS safe_max FROM b),
    d AS (SELECT *, least(safe_max, {_P2.format('base')})::BIGINT AS recommended FROM c)
    SELECT records::BIGINT AS records, features::BIGINT AS features, profile, ram_gb, train::BIGINT AS train, least(safe_max, greatest(2, recommended // 2))::BIGINT AS safe_min, recommended, safe_max FROM d""")
def batch_plan(spark, sf):
    t = grid(spark)
    p = planners.batch_plan(F.col("records"), F.col("features"), F.col("profile"), F.col("ram_gb"), F.lit(50))
    return t.select("records", "features", "profile", "ram_gb", p.alias("p")).select("records", "features", "profile", "ram_gb", "p.*")


@query(f"""WITH g AS (SELECT DISTINCT profile, features, ram_gb AS threads FROM ({GRID})), m AS (SELECT *, CASE profile WHEN 'eco' THEN 'weak' WHEN 'low-memory' THEN 'weak' WHEN 'custom' THEN 'balanced' ELSE profile END AS mode FROM g),
    x AS (SELECT *, CASE mode WHEN 'weak' THEN 0.25::DOUBLE WHEN 'balanced' THEN 0.5 WHEN 'performance' THEN 0.75 ELSE 1 END AS fr, CASE mode WHEN 'weak' THEN 8 WHEN 'balanced' THEN 32 ELSE 100 END AS cap, CASE mode WHEN 'weak' THEN 33554432 WHEN 'balanced' THEN 100663296 WHEN 'performance' THEN 268435456 ELSE 805306368 END::BIGINT AS arena, 64::BIGINT * (features + 1) * 4 AS bb FROM m)
    SELECT profile, features::BIGINT AS features, threads, mode, greatest(1, least(threads, round_even(threads * fr, 0)::INTEGER)) AS used, cap AS bulk_step_cap, least(arena, greatest(8388608, bb * 3, bb * 8, arena // 4))::BIGINT AS arena_bytes, bb::BIGINT AS batch_bytes FROM x""")
def execution_plan(spark, sf):
    t = grid(spark).select("profile", "features", F.col("ram_gb").alias("threads")).distinct()
    p = planners.execution_plan(F.col("profile"), F.col("threads"), F.lit(64), F.col("features"))
    return t.select("profile", "features", "threads", p.alias("p")).select("profile", "features", F.col("threads"), "p.mode", F.col("p.threads").alias("used"), "p.bulk_step_cap", "p.arena_bytes", "p.batch_bytes")


@query("""SELECT t AS threads, r AS ram_gb, v AS vram_gb, CASE WHEN t <= 6 OR r < 12 THEN 'low-memory' WHEN t >= 32 AND r >= 64 AND (v >= 16 OR (t >= 64 AND r >= 128)) THEN 'workstation' WHEN t >= 16 AND r >= 32 AND v >= 8 THEN 'performance' ELSE 'balanced' END AS profile
    FROM (VALUES (4), (8), (16), (32), (64)) AS a(t), (VALUES (8), (16), (32), (64), (128)) AS b(r), (VALUES (0), (8), (16)) AS c(v)""")
def hardware_profile(spark, sf):
    t = spark.createDataFrame([(t, r, v) for t in (4, 8, 16, 32, 64) for r in (8, 16, 32, 64, 128) for v in (0, 8, 16)], "threads int, ram_gb int, vram_gb int")
    return t.withColumn("profile", planners.profile(F.col("threads"), F.col("ram_gb"), F.col("vram_gb")))


@query("""SELECT part.p_partkey AS k, coalesce(e, n, c, 'd') AS value, CASE WHEN e IS NOT NULL THEN 'explicit' WHEN n IS NOT NULL THEN 'environment' WHEN c IS NOT NULL THEN 'config' ELSE 'default' END AS source
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'e' END AS e, CASE WHEN p_partkey % 3 = 0 THEN 'n' END AS n, CASE WHEN p_partkey % 5 = 0 THEN 'c' END AS c FROM part) part""")
def config_precedence(spark, sf):
    k = F.col("p_partkey")
    t = load(spark, sf, "part")
    r = planners.resolved(F.when(k % 2 == 0, "e"), F.when(k % 3 == 0, "n"), F.when(k % 5 == 0, "c"), F.lit("d"))
    return t.select(k.alias("k"), r.alias("r")).select("k", "r.*")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def latest_version(spark, sf):
    t = load(spark, sf, "events").select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))
    return catalog.latest(t, "user_id", "event_id", "gone").drop("gone")


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def action_tail(spark, sf):
    return catalog.since(load(spark, sf, "events").select("event_id", "event_type"), 500, 100, "event_id")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def recent_actions(spark, sf):
    return catalog.recent(load(spark, sf, "events").select("event_id", "event_type"), 50, "event_id")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def page(spark, sf):
    return catalog.page(load(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 25, 50)


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 128")
def trace_tail(spark, sf):
    return catalog.trace_tail(load(spark, sf, "events"), "ts", "event_id").select("event_id", "event_type")


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_id, arg_max(value, event_id) AS last_value FROM events GROUP BY 1")
def trace_summary(spark, sf):
    t = load(spark, sf, "events")
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"), F.max_by("value", "event_id").alias("last_value"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_anti_join(spark, sf):
    return catalog.orphans(load(spark, sf, "documents").select("doc_id", "n_chars"), load(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text), lang) AS first FROM documents")
def dedupe_by_hash(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))
    return catalog.reuse(t, "sha256", "lang", "doc_id").select("doc_id", "first")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def run_dataset_join(spark, sf):
    o = load(spark, sf, "orders").where("o_orderstatus = 'F'")
    return o.join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events")
def capability_union(spark, sf):
    t = load(spark, sf, "events").select(F.array("event_type").alias("kinds"))
    return catalog.set_union(t, ["kinds"]).select(F.array_join("kinds", ",").alias("kinds"))


@query("SELECT event_type, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1")
def first_wins(spark, sf):
    return catalog.first_wins(load(spark, sf, "events").select("event_type", "event_id", "user_id"), "event_type", "event_id")
