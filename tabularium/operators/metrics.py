"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(F.lit(1), b)


def _f1(p: Column, r: Column) -> Column:
    return 2 * p * r / F.greatest(F.lit(1e-12), p + r)


def binary_metrics(df: DataFrame, truth: str = "truth", p: str = "p") -> DataFrame:
    """One row: n, tp, fp, fn, accuracy, precision, recall, f1 at a threshold of one half."""
    t, g = F.col(truth) == 1, F.col(p) >= 0.5
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.avg((t == g).cast("double")).alias("accuracy"))
    out = out.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def log_loss(y: Column, p: Column) -> Column:
    """Mean cross entropy of two classes, an aggregate expression."""
    return -F.avg(y * F.log(p + EPS) + (1 - y) * F.log(1 - p + EPS))


def roc_auc(df: DataFrame, truth: str = "truth", p: str = "p") -> DataFrame:
    """One row: auc with ties as one half, null when a class is empty.

    Rank sums over groups of equal scores. Groups are numbered in buckets of score
    quantiles, so no task sorts all scores.
    """
    from tabularium.operators.order import with_running_sum

    g = df.groupBy(F.col(p).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(truth).cast("long")).alias("np"))
    g = with_running_sum(g, ["s"], "n", "upto")
    ranks = g.agg(F.sum(F.col("np") * (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)).alias("rs"), F.sum("np").alias("pos"), F.sum(F.col("n") - F.col("np")).alias("neg"))
    auc = (F.col("rs") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return ranks.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), auc).alias("auc"), F.coalesce("pos", F.lit(0)).alias("positives"), F.coalesce("neg", F.lit(0)).alias("negatives"))


def confusion(df: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """(truth, guess, n) of the pairs that occur."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """(truth, row): counts in the order of all classes of either side. There are few classes."""
    counts = confusion(df, truth, guess)
    classes = sorted({r[0] for r in counts.select(F.explode(F.array("truth", "guess"))).distinct().collect()})
    wide = counts.groupBy("truth").pivot("guess", classes).agg(F.sum("n")).na.fill(0)
    every = df.sparkSession.createDataFrame([(c,) for c in classes], counts.select("truth").schema)
    full = every.join(wide, "truth", "left").na.fill(0)
    return full.select("truth", F.array(*(F.col(f"`{c}`") for c in classes)).alias("row"))


def multiclass_metrics(df: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """One row: accuracy, macro_f1, micro_f1 over the classes of truth or guess."""
    c = confusion(df, truth, guess)
    cells = c.select(F.explode(F.array(F.struct(F.col("truth").alias("k"), F.col("n").alias("t"), F.lit(0).cast("long").alias("g"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("guess").alias("k"), F.lit(0).cast("long").alias("t"), F.col("n").alias("g"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    per = cells.groupBy("k").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("tp").alias("tp"))
    f1 = _f1(_ratio(F.col("tp"), F.col("g")), _ratio(F.col("tp"), F.col("t")))
    return per.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.sum("tp") / F.sum("t")).alias("micro_f1"), F.count(F.lit(1)).alias("classes"))


def multiclass_log_loss(df: DataFrame, truth: str, probabilities: str) -> DataFrame:
    return df.agg((-F.avg(F.log(F.get(F.col(probabilities), F.col(truth).cast("int")) + EPS))).alias("loss"))


def regression_metrics(df: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """One row: n, mse, mae, rmse, r2 (0 for a constant truth)."""
    e = F.col(guess) - F.col(truth)
    out = df.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (F.var_pop(truth) * F.count(F.lit(1))).alias("sst"))
    return out.select("n", "mse", "mae", F.sqrt("mse").alias("rmse"), F.when(F.col("sst") > 1e-12, 1 - F.col("mse") * F.col("n") / F.col("sst")).otherwise(0.0).alias("r2"))


def latency_summary(df: DataFrame, ms: str = "ms") -> DataFrame:
    """One row: requests, total, mean, median, p95 and requests per second.

    p95 is the value at place round(0.95 n + 0.5), halves to even, counted from 1.
    """
    from tabularium.operators.order import with_ordinal

    ranked = with_ordinal(df.select(F.col(ms).alias("ms")), ["ms"], "place")
    n = df.count()
    at = min(n - 1, max(0, round(0.95 * n + 0.5) - 1))
    s = F.sum("ms")
    return ranked.agg(
        F.count(F.lit(1)).alias("requests"), s.alias("total_ms"), F.avg("ms").alias("mean_ms"), F.median("ms").alias("median_ms"),
        F.max(F.when(F.col("place") == at, F.col("ms"))).alias("p95_ms"), (1000.0 * F.count(F.lit(1)) / F.greatest(s, F.lit(1e-9))).alias("requests_per_second"),
    )


def share_of_weights(weight: Column, host: str, least: int = 5) -> Column:
    """round(100 w / sum w) among the runs of one host, halves to even, ``least`` at least."""
    return F.greatest(F.lit(least), F.bround(100 * weight / F.sum(weight).over(Window.partitionBy(host))).cast("int"))
