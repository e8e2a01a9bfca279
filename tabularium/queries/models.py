"""Metrics, training steps, predictions and vector kernels."""

from pyspark.sql import functions as F

from tabularium.functions import numbers as N
from tabularium.operators import metrics, prepare
from tabularium.operators.train import Linear, train
from tabularium.queries import load, query

SCORES = "SELECT event_id, (event_type = 'purchase')::INTEGER AS truth, ((event_id * 37) % 101)::DOUBLE / 100 AS p FROM events"


def scores(spark, sf):
    t = load(spark, sf, "events")
    return t.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("truth"), ((F.col("event_id") * 37 % 101).cast("double") / 100).alias("p"))


@query(f"""WITH s AS ({SCORES}), c AS (SELECT count(*) AS n, count(*) FILTER (truth = 1 AND p >= 0.5::DOUBLE) AS tp, count(*) FILTER (truth = 0 AND p >= 0.5::DOUBLE) AS fp,
    count(*) FILTER (truth = 1 AND p < 0.5::DOUBLE) AS fn FROM s), r AS (SELECT *, tp::DOUBLE / greatest(1, tp + fp) AS pr, tp::DOUBLE / greatest(1, tp + fn) AS re FROM c)
    SELECT n, tp, fp, fn, round((n - fp - fn)::DOUBLE / n, 9) AS accuracy, round(pr, 9) AS precision, round(re, 9) AS recall, round(2 * pr * re / greatest(1e-12::DOUBLE, pr + re), 9) AS f1 FROM r""")
def binary_metrics(spark, sf):
    m = metrics.binary_metrics(scores(spark, sf))
    return m.select("n", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query(f"SELECT round(-avg(truth * ln(p + 1e-8::DOUBLE) + (1 - truth) * ln(1 - p + 1e-8::DOUBLE)), 8) AS loss FROM (SELECT truth, least(p, 0.99::DOUBLE) AS p FROM ({SCORES}))")
def binary_logloss(spark, sf):
    return scores(spark, sf).withColumn("p", F.least("p", F.lit(0.99))).agg(F.round(metrics.log_loss(F.col("truth"), F.col("p")), 8).alias("loss"))


@query(f"""WITH s AS ({SCORES}), g AS (SELECT p, count(*) AS n, sum(truth) AS np FROM s GROUP BY p), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb FROM g),
    r AS (SELECT sum(np * (cb + (n + 1) / 2::DOUBLE)) AS rs, sum(np)::BIGINT AS pos, sum(n - np)::BIGINT AS neg FROM c)
    SELECT round((rs - pos * (pos + 1) / 2::DOUBLE) / (pos::DOUBLE * neg), 9) AS auc, pos AS positives, neg AS negatives FROM r""")
def roc_auc(spark, sf):
    return metrics.roc_auc(scores(spark, sf)).select(F.round("auc", 9).alias("auc"), "positives", "negatives")


GUESS = "SELECT event_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::INTEGER - 1 AS truth, (user_id % 5)::INTEGER AS guess FROM events"


def guesses(spark, sf):
    names = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    return load(spark, sf, "events").select("event_id", (F.array_position(names, F.col("event_type")) - 1).cast("int").alias("truth"), (F.col("user_id") % 5).cast("int").alias("guess"))


@query(f"SELECT truth, guess, count(*) AS n FROM ({GUESS}) GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return metrics.confusion(guesses(spark, sf))


@query(f"SELECT truth, array_to_string(list(n ORDER BY guess), ',') AS row FROM (SELECT t.c AS truth, g.c AS guess, count(x.event_id) AS n FROM range(5) AS t(c) CROSS JOIN range(5) AS g(c) LEFT JOIN ({GUESS}) x ON x.truth = t.c AND x.guess = g.c GROUP BY 1, 2) GROUP BY 1".replace("t.c AS truth", "t.c::INTEGER AS truth"))
def confusion_rows(spark, sf):
    return metrics.confusion_matrix(guesses(spark, sf)).select("truth", F.array_join(F.transform("row", lambda x: x.cast("string")), ",").alias("row"))


@query(f"""WITH x AS ({GUESS}), k AS (SELECT c, (SELECT count(*) FROM x WHERE truth = c AND guess = c) AS tp, (SELECT count(*) FROM x WHERE guess = c) AS g, (SELECT count(*) FROM x WHERE truth = c) AS t FROM range(5) AS r(c)),
    f AS (SELECT *, tp::DOUBLE / greatest(1, g) AS p, tp::DOUBLE / greatest(1, t) AS r FROM k)
    SELECT round(sum(tp)::DOUBLE / sum(t), 9) AS accuracy, round(avg(2 * p * r / greatest(1e-12::DOUBLE, p + r)), 9) AS macro_f1, round(sum(tp)::DOUBLE / sum(t), 9) AS micro_f1, count(*) AS classes FROM f""")
def multiclass_metrics(spark, sf):
    return metrics.multiclass_metrics(guesses(spark, sf)).select(*(F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "micro_f1")), "classes")


@query("""WITH x AS (SELECT l_extendedprice AS t, 1500.0::DOUBLE * l_quantity - l_extendedprice AS e FROM lineitem), s AS (SELECT count(*) AS n, avg(e * e) AS mse, avg(abs(e)) AS mae, var_pop(t) AS v FROM x)
    SELECT n, round(mse, 2) AS mse, round(mae, 4) AS mae, round(sqrt(mse), 4) AS rmse, round(1 - mse / v, 8) AS r2 FROM s""")
def regression_metrics(spark, sf):
    t = load(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("truth"), (1500.0 * F.col("l_quantity")).alias("guess"))
    return metrics.regression_metrics(t).select("n", F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 8).alias("r2"))


FEATURES = ["l_quantity", "l_discount", "l_tax"]
ROWS = """s AS (SELECT avg(l_quantity) AS a0, stddev_pop(l_quantity) AS b0, avg(l_discount) AS a1, stddev_pop(l_discount) AS b1, avg(l_tax) AS a2, stddev_pop(l_tax) AS b2, avg(l_extendedprice) AS ty, stddev_pop(l_extendedprice) AS sy FROM lineitem),
    x AS (SELECT (l_quantity - a0) / b0 AS x0, (l_discount - a1) / b1 AS x1, (l_tax - a2) / b2 AS x2, (l_returnflag = 'R')::INTEGER::DOUBLE AS y, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS k, (l_extendedprice - ty) / sy AS v FROM lineitem, s)"""


def rows(spark, sf, label):
    t = load(spark, sf, "lineitem")
    s = {r.feature: r for r in prepare.numeric_stats(t, [*FEATURES, "l_extendedprice"]).collect()}
    x = F.array(*((F.col(c) - s[c]["mean"]) / s[c]["std"] for c in FEATURES))
    return t.select(x.alias("features"), label.cast("double").alias("label")), s["l_extendedprice"]


def weights_row(spark, model):
    return spark.createDataFrame([(k, j, float(w)) for k, row in enumerate(model.weights) for j, w in enumerate([*row, model.bias[k]])], "class int, place int, weight double").select("class", "place", F.round("weight", 9).alias("weight"))


def steps_sql(steps: int, error: str, rate: float, decay: float, factor: str) -> str:
    ctes = ["w0 AS (SELECT 0::DOUBLE AS w0, 0::DOUBLE AS w1, 0::DOUBLE AS w2, 0::DOUBLE AS b)"]
    for i in range(1, steps + 1):
        ctes.append(f"e{i} AS (SELECT x0, x1, x2, {error.replace('Z', 'x0 * w0 + x1 * w1 + x2 * w2 + b')} AS e, w0, w1, w2, b FROM x, w{i - 1})")
        grads = ", ".join(f"any_value(w{j}) - {rate}::DOUBLE * ({factor} * avg(x{j} * e) + {decay}::DOUBLE * any_value(w{j})) AS w{j}" for j in range(3))
        ctes.append(f"w{i} AS (SELECT {grads}, any_value(b) - {rate}::DOUBLE * {factor} * avg(e) AS b FROM e{i})")
    return f"WITH {ROWS}, {', '.join(ctes)} SELECT 0::INTEGER AS class, p::INTEGER AS place, round(CASE p WHEN 0 THEN w0 WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE b END, 9) AS weight FROM w{steps}, range(4) AS r(p)"


@query(steps_sql(3, "1 / (1 + exp(-greatest(-30, least(30, Z)))) - y", 0.5, 0.01, "1"))
def logistic_steps(spark, sf):
    df, _ = rows(spark, sf, F.col("l_returnflag") == "R")
    return weights_row(spark, train(df, Linear.zeros("binary_classification", 3), 3, 0.5, 0.01))


@query(steps_sql(3, "Z - v", 0.1, 0.01, "2"))
def linear_steps(spark, sf):
    df, s = rows(spark, sf, F.col("l_extendedprice"))
    return weights_row(spark, train(df, Linear.zeros("regression", 3, target_mean=s["mean"], target_std=s["std"]), 3, 0.1, 0.01))


def softmax_sql(steps: int, rate: float, decay: float) -> str:
    names = [f"w{k}{j}" for k in range(3) for j in range(4)]
    ctes = [f"p0 AS (SELECT {', '.join(f'0::DOUBLE AS {n}' for n in names)})"]
    z = lambda k: f"x0 * w{k}0 + x1 * w{k}1 + x2 * w{k}2 + w{k}3"
    for i in range(1, steps + 1):
        ctes.append(f"z{i} AS (SELECT x.*, p.*, {', '.join(f'{z(k)} AS z{k}' for k in range(3))} FROM x, p{i - 1} p)")
        ctes.append(f"q{i} AS (SELECT *, {', '.join(f'exp(z{k} - greatest(z0, z1, z2)) AS q{k}' for k in range(3))} FROM z{i})")
        ctes.append(f"e{i} AS (SELECT *, {', '.join(f'q{k} / (q0 + q1 + q2) - (k = {k})::INTEGER AS e{k}' for k in range(3))} FROM q{i})")
        upd = [f"any_value(w{k}{j}) - {rate}::DOUBLE * (avg(x{j} * e{k}) + {decay}::DOUBLE * any_value(w{k}{j})) AS w{k}{j}" if j < 3 else f"any_value(w{k}3) - {rate}::DOUBLE * avg(e{k}) AS w{k}3" for k in range(3) for j in range(4)]
        ctes.append(f"p{i} AS (SELECT {', '.join(upd)} FROM e{i})")
    out = " UNION ALL ".join(f"SELECT {k}::INTEGER AS class, {j}::INTEGER AS place, round(w{k}{j}, 9) AS weight FROM p{steps}" for k in range(3) for j in range(4))
    return f"WITH {ROWS}, {', '.join(ctes)} {out}"


@query(softmax_sql(2, 0.5, 0.01))
def softmax_steps(spark, sf):
    df, _ = rows(spark, sf, F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    return weights_row(spark, train(df, Linear.zeros("multiclass_classification", 3, 3), 2, 0.5, 0.01))


@query("SELECT l_orderkey, l_linenumber, round(0.02::DOUBLE * l_quantity - 3.0::DOUBLE * l_discount + 0.1::DOUBLE, 9) AS prediction FROM lineitem")
def predict_linear(spark, sf):
    import numpy as np

    model = Linear("regression", np.array([[0.02, -3.0]]), np.array([0.1]), 0.0, 1.0)
    t = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount").alias("features"))
    return model.predict(t).select("l_orderkey", "l_linenumber", F.round("prediction", 9).alias("prediction"))


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, 0.05::DOUBLE * l_quantity - 1 AS z0, 20.0::DOUBLE * l_discount - 1 AS z1, 0.1::DOUBLE AS z2 FROM lineitem), e AS (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM z)
    SELECT l_orderkey, l_linenumber, round(greatest(e0, e1, e2) / (e0 + e1 + e2), 8) AS p, (CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END)::DOUBLE AS prediction FROM e""")
def predict_softmax(spark, sf):
    import numpy as np

    model = Linear("multiclass_classification", np.array([[0.05, 0.0], [0.0, 20.0], [0.0, 0.0]]), np.array([-1.0, -1.0, 0.1]))
    t = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount").alias("features"))
    return model.predict(t).select("l_orderkey", "l_linenumber", F.round(F.array_max("probabilities"), 8).alias("p"), "prediction")


VEC = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


@query(f"""SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 8) AS norm, round(list_sum(list_transform(v, lambda x, i: x * (i % 3))), 8) AS dotted,
    round(list_sum(list_transform(v, lambda x, i: x + (i % 3) * 0.5::DOUBLE)), 8) AS axpy, round(list_sum(list_transform(v, lambda x: greatest(-0.1::DOUBLE, least(0.1::DOUBLE, x)))), 8) AS clipped,
    true AS finite, (list_position(v, list_max(v)) - 1)::INTEGER AS top FROM ({VEC})""")
def vector_kernels(spark, sf):
    t = load(spark, sf, "embeddings").select("vec_id", N.doubles(F.col("embedding")).alias("v"))
    w = F.transform("v", lambda x, i: ((i + 1) % 3).cast("double"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 8)
    return t.select(
        "vec_id", F.round(N.l2_norm(F.col("v")), 8).alias("norm"), F.round(N.dot(F.col("v"), w), 8).alias("dotted"), total(N.axpy(F.col("v"), w, 0.5)).alias("axpy"),
        total(N.clip(F.col("v"), 0.1)).alias("clipped"), N.all_finite(F.col("v")).alias("finite"), N.argmax(F.col("v")).alias("top"),
    )


@query(f"""WITH v AS ({VEC}), s AS (SELECT i, avg(v[i]) AS mu, stddev_pop(v[i]) AS sd FROM v, range(1, 65) AS r(i) GROUP BY i), z AS (SELECT vec_id, i, (v[i] - mu) / sd AS z FROM v JOIN s ON true)
    SELECT vec_id, round(sum(z), 6) AS total, round(max(z), 6) AS largest FROM z GROUP BY vec_id""")
def normalize_vectors(spark, sf):
    t = load(spark, sf, "embeddings").select("vec_id", N.doubles(F.col("embedding")).alias("v"))
    s = t.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    z = t.select("vec_id", N.normalize(F.col("v"), F.lit([r.m for r in s]), F.lit([r.s for r in s])).alias("z"))
    return z.select("vec_id", F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("z"), 6).alias("largest"))


@query(f"""SELECT vec_id, round(list_sum(list_transform(v, lambda x, i: x - 0.1::DOUBLE * ((i % 4) + 0.5::DOUBLE * x))), 8) AS total FROM ({VEC})""")
def weight_update(spark, sf):
    t = load(spark, sf, "embeddings").select("vec_id", N.doubles(F.col("embedding")).alias("v"))
    g = F.transform("v", lambda x, i: ((i + 1) % 4).cast("double"))
    return t.select("vec_id", F.round(F.aggregate(N.weight_update(F.col("v"), g, 0.1, 0.5), F.lit(0.0), lambda a, x: a + x), 8).alias("total"))


@query("""WITH o AS (SELECT abs(value) AS ms, row_number() OVER (ORDER BY abs(value)) AS k, count(*) OVER () AS n FROM events)
    SELECT count(*) AS requests, round(sum(ms), 4) AS total_ms, round(avg(ms), 6) AS mean_ms, round(median(ms), 6) AS median_ms, round(max(ms) FILTER (k = least(n, greatest(1, round_even(0.95 * n + 0.5, 0)::BIGINT))), 6) AS p95_ms,
    round(1000.0::DOUBLE * count(*) / greatest(sum(ms), 1e-9::DOUBLE), 3) AS requests_per_second FROM o""")
def latency_summary(spark, sf):
    t = load(spark, sf, "events").select(F.abs("value").alias("ms"))
    m = metrics.latency_summary(t)
    return m.select("requests", F.round("total_ms", 4).alias("total_ms"), *(F.round(c, 6).alias(c) for c in ("mean_ms", "median_ms", "p95_ms")), F.round("requests_per_second", 3).alias("requests_per_second"))
