import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.operators.train import Linear, gradient, train, train_block
from tabularium.plans.engine import Config, Engine
from tabularium.plans.rpc import serve


@pytest.fixture(scope="module")
def csvs(tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    (d / "binary.csv").write_text("x1,x2,x3,target\n" + "".join(f"{(a := math.sin(i / 7))},{(b := math.cos(i / 11))},{(c := (i % 13) / 13)},{int(a + b + c > 0.75)}\n" for i in range(400)))
    (d / "regression.csv").write_text("x1,x2,target\n" + "".join(f"{i},{i % 11},{0.75 * i + 0.2 * (i % 11)}\n" for i in range(300)))
    (d / "multi.jsonl").write_text("\n".join(json.dumps({"x1": i % 3 * 2.0 + (i % 7) / 50, "x2": -(i % 3) ** 2 + (i % 5) / 50, "target": f"class-{i % 3}"}) for i in range(300)))
    return d


def test_fit_binary_and_predict(spark, csvs, tmp_path):
    e = Engine(spark, str(tmp_path / "ws"))
    r = e.fit(str(csvs / "binary.csv"), max_steps=400, learning_rate=0.5)
    assert r.plan.task == "binary_classification" and r.test["accuracy"] > 0.85 and r.test["roc_auc"] > 0.9
    assert Linear.from_json(r.checkpoint).weights == pytest.approx(r.model.weights)
    with pytest.raises(ValueError):
        Linear.from_json(r.checkpoint.replace('"step": 4', '"step": 5') if '"step": 4' in r.checkpoint else r.checkpoint.replace('"bias": [', '"bias": [1'))
    df = e.read(str(csvs / "binary.csv")).drop("target")
    assert e.predict(r, df, ("x1",)).count() == 400
    check = e.inference_check(r, e.read(str(csvs / "binary.csv")))
    assert check["requests"] == 16 and check["unchanged"]
    assert e.store.get("runs", r.run_id)["task"] == "binary_classification"
    assert e.store.page("runs", status="completed").count() == 1
    assert e.store.run_log(r.run_id).count() == 1
    e.store.delete("runs", r.run_id)
    assert e.store.get("runs", r.run_id) is None
    tuned = e.finetune(r, str(csvs / "binary.csv"), max_steps=40)
    assert tuned.best_score >= r.best_score - 1e-12


def test_fit_regression_and_classes(spark, csvs):
    e = Engine(spark, config=Config(max_steps=300, learning_rate=0.2))
    assert e.fit(str(csvs / "regression.csv")).test["r2"] > 0.99
    r = e.fit(str(csvs / "multi.jsonl"))
    assert r.encoder.classes == ["class-0", "class-1", "class-2"] and r.test["accuracy"] > 0.9


def test_stream_mode(spark, csvs):
    r = Engine(spark).fit(str(csvs / "binary.csv"), stream=True, max_steps=200, learning_rate=0.5)
    assert r.plan.stream and r.test["accuracy"] > 0.8


def test_plan_and_ranges(spark, csvs):
    e = Engine(spark).configure(profile="eco")
    p = e.plan(str(csvs / "binary.csv"), batch=4096)
    assert p.batch == 320 and p.warnings and p.rows == 400
    with pytest.raises(ValueError):
        e.plan(str(csvs / "binary.csv"), ram_percent=5)
    with pytest.raises(ValueError):
        e.plan(str(csvs / "binary.csv"), "nothing")
    assert e.inspect(str(csvs / "binary.csv"))["target"] == "target"


def test_rpc(spark, csvs):
    lines = ['{"id": 1, "method": "ping"}', "", '{"id": 2, "method": "nope"}', "{", json.dumps({"id": 3, "method": "plan", "params": {"path": str(csvs / "binary.csv")}})]
    got = [json.loads(x) for x in serve(Engine(spark), lines)]
    assert got[0]["result"] == "pong" and "error" in got[1] and "error" in got[2] and got[3]["result"]["task"] == "binary_classification"


def test_steps_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(64, 3)), rng.integers(0, 3, 64).astype(float)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "features array<double>, label double")
    for task, k, label in (("binary_classification", 1, y > 0), ("multiclass_classification", 3, y), ("regression", 1, y)):
        got = train(df.withColumn("label", (F.col("label") > 0).cast("double")) if k == 1 and task[0] == "b" else df, Linear.zeros(task, 3, k, 0.5, 2.0), 3, 0.3, 0.01)
        w, b = np.zeros((k, 3)), np.zeros(k)
        for _ in range(3):
            z = x @ w.T + b
            if task[0] == "b":
                e = (1 / (1 + np.exp(-z[:, 0])) - label)[:, None]
            elif task[0] == "m":
                p = np.exp(z - z.max(1, keepdims=True))
                e = p / p.sum(1, keepdims=True) - np.eye(3)[label.astype(int)]
            else:
                e = 2 * (z[:, 0] - (label - 0.5) / 2.0)[:, None]
            w, b = w - 0.3 * (e.T @ x / 64 + 0.01 * w), b - 0.3 * e.mean(0)
        assert got.weights == pytest.approx(w) and got.bias == pytest.approx(b)


def test_block_training_lowers_the_loss(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] > 0).astype(float)
    m = train_block(x, y, Linear.zeros("binary_classification", 4), 400, 64, 0.5)
    assert np.mean(m.history[-50:]) < 0.3 * m.history[0]
    with pytest.raises(ValueError):
        train_block(np.zeros((70_000, 1)), np.zeros(70_000), Linear.zeros("regression", 1), 1, 1, 0.1)


def test_gradient_refuses_nothing(spark):
    with pytest.raises(ValueError):
        gradient(spark.createDataFrame([], "features array<double>, label double"), Linear.zeros("regression", 2))


def test_fit_a_folder_as_a_stream(spark, csvs, tmp_path):
    lines = (csvs / "binary.csv").read_text().splitlines()
    (tmp_path / "b.csv").write_text("\n".join([lines[0], *lines[1:301]]))
    (tmp_path / "A.csv").write_text("\n".join([lines[0], *lines[301:]]))
    r = Engine(spark).fit(str(tmp_path), "target", stream=True, max_steps=200, learning_rate=0.5)
    assert r.plan.rows == 400 and r.test["accuracy"] > 0.75


def test_plan_many_and_fit_many(spark, csvs):
    e = Engine(spark, config=Config(max_steps=40))
    assert [p.task for p in e.plan_many([str(csvs / "binary.csv"), (str(csvs / "regression.csv"), "target")])] == ["binary_classification", "regression"]
    assert len(e.fit_many([str(csvs / "binary.csv"), str(csvs / "multi.jsonl")])) == 2


def test_steps_are_the_same_however_many_rows_the_driver_holds(spark, csvs, monkeypatch):
    from tabularium.plans import engine

    fits = []
    for held in (65_536, 100):
        monkeypatch.setattr(engine, "BLOCK_ROWS", held)
        fits.append(Engine(spark).fit(str(csvs / "binary.csv"), max_steps=24, learning_rate=0.5))
    a, b = fits
    assert a.model.step == b.model.step > 0 and a.plan.batch < 400
    assert a.model.weights == pytest.approx(b.model.weights) and np.array(a.history) == pytest.approx(np.array(b.history))


def test_next_batch_follows_the_fold(spark):
    from tabularium.operators import guard

    rng = np.random.default_rng(0)
    for _ in range(5):
        scores = rng.uniform(0.4, 0.6, 8).round(2).tolist()
        batch = 64
        for k in range(len(scores)):
            batch = guard.next_batch(scores[: k + 1], batch, 16, 256, 4000)
        table = spark.createDataFrame([("r", k, x) for k, x in enumerate(scores)], "run string, step long, score double")
        assert guard.adapt_batch(table, "run", "step", "score", 64, 16, 256, 4000).first().batch == batch
