import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import toxicity as X

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = X.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").toPandas()
    toxic = rows[rows.toxic == 1]
    assert (toxic.predicted == 1).mean() > 0.8
    assert (rows[rows.toxic == 0].predicted == 0).mean() > 0.99
    assert ((rows.predicted == rows.toxic).mean()) > 0.97


def test_held_out_rows_and_labels_of_others_are_never_used(tables):
    docs, labels = tables
    few, own = docs.limit(3000), labels
    flipped = own.withColumn("toxic", F.when(X.is_held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.train(few, own), X.train(few, flipped)
    assert a.weights == b.weights and a.bias == b.bias
    got = {r.doc_id: r.held_out for r in X.score(few, a).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got.items())


def test_score_equals_the_sum_of_features(tables, odd_docs):
    docs, labels = tables
    m = X.train(docs.limit(3000), labels)
    for r in docs.limit(50).collect() + odd_docs.collect():
        z = m.bias + sum(m.weights.get(f, 0.0) for f in X.features(r.text or ""))
        assert m.score(r.text or "") == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_odd_and_empty(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    rows = X.toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert X.toxicity(no_docs, labels).count() == 0
    assert X.toxicity(odd_docs, labels.limit(0)).count() == len(rows)
    kept = X.keep_civil(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == len(rows)


def test_seed_lexicon_without_labels():
    m = X._fallback()
    assert m.score("You are a stupid idiot") >= X.THRESHOLD > m.score("A fine day") and m.score("") < 0.5


def test_label_model_finds_accuracies_and_repetitions():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.15
    right = lambda p, q: np.where(y, rng.random(6000) < p, rng.random(6000) < q)
    a, b, c, noise = right(0.5, 0.005), right(0.4, 0.01), right(0.45, 0.005), rng.random(6000) < 0.1
    votes = np.column_stack([a, a, a, b, c, noise])
    clean = ~votes[:, :5].any(1)
    q, acc, corr = X.label_model(votes, clean.astype(float), 0.15, np.zeros(6), np.zeros(6))
    assert corr[0, 1] > 0.99 and abs(corr[0, 3]) < 0.3
    assert acc[5] < 0.4 < 0.45 < min(acc[0], acc[3], acc[4])
    seen = votes[:, :5].any(1)
    assert ((q >= 0.5) == y)[seen].mean() > 0.85


def test_linear_fit_and_platt():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(40) < 0.2).astype(np.int32) for _ in range(3000)]
    y = np.array([0 in r for r in rows], float)
    w, b, z = X.fit_linear(rows, 40, y)
    assert w[0] > 2 and np.abs(w[1:]).max() < 0.3
    slope, shift = X.platt(z, y > 0)
    p = 1 / (1 + np.exp(-(slope * z + shift)))
    assert p[y > 0].min() > 0.9 and p[y == 0].max() < 0.1
