import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.functions.hashing import blake2b_long, context_key
from tabularium.operators import layers, metrics, profile
from tabularium.operators.train import Linear
from tabularium.plans.catalog_store import Store
from tabularium.plans.datasets import Checkpoints, DatasetError, Datasets, demo, normal_run
from tabularium.sources import files


@pytest.fixture
def data(spark, tmp_path):
    return Datasets(Store(spark, str(tmp_path / "ws")))


def table(path, rows=80):
    path.write_text("x,c,y\n" + "".join(f"{k},{'ab'[k % 2]},{int(k % 3 == 0)}\n" for k in range(rows)))
    return str(path)


def test_import_reuses_and_loads(data, tmp_path):
    path = table(tmp_path / "a.csv")
    key = data.import_file(path)
    assert data.import_file(path) == key and key.startswith("ds_")
    assert data.import_file(path, "c") != key
    assert data.load(key).count() == 80
    assert data.store.get("datasets", key)["task"] == "binary_classification"
    assert data.health().count() == 0
    data.store.delete("datasets", key)
    assert data.health().count() == 1
    np.savez(tmp_path / "n.npz", x=np.random.default_rng(0).normal(size=(60, 2)), y=np.arange(60) % 2)
    assert data.load(data.import_file(str(tmp_path / "n.npz"))).count() == 60


def test_attached_sources_must_not_change(data, tmp_path):
    path = table(tmp_path / "a.csv")
    key = data.attach(path, "y")
    assert data.attach(path, "y") == key and data.load(key).count() == 80
    assert data.store.get("datasets", key)["numeric"] == ["x"]
    table(tmp_path / "a.csv", 81)
    with pytest.raises(DatasetError):
        data.load(key)


def test_manifest_round_trip(spark, data, tmp_path):
    data.import_file(table(tmp_path / "a.csv"))
    data.store.save("runs", "r1", {"status": "training", "target_metric": 0.8})
    raw = data.export_manifest()
    other = Datasets(Store(spark, str(tmp_path / "ws2")))
    assert other.import_manifest(raw) == {"datasets": 1, "runs": 1}
    run = other.store.get("runs", "r1")
    assert run["status"] == "error_recoverable" and run["target_score"] == 0.8 and run["batch_size"] == 32
    with pytest.raises(DatasetError):
        other.import_manifest(raw.replace("training", "stopped"))
    with pytest.raises(DatasetError):
        other.import_manifest(json.dumps({"contract": "x"}))
    assert normal_run({})["target_score"] == 0.92


def test_checkpoints(spark, tmp_path):
    c = Checkpoints(Store(spark, str(tmp_path / "ws")))
    model = Linear("regression", np.array([[1.0, 2.0]]), np.array([0.5]))
    c.record("r", model, task="regression")
    with pytest.raises(ValueError):
        c.load("r")
    c.promote("r", task="regression")
    assert c.load("r", task="regression").weights.tolist() == [[1.0, 2.0]]
    with pytest.raises(ValueError):
        c.load("r", task="binary_classification")
    c.discard_last("r")
    with pytest.raises(ValueError):
        c.load("r", "last")


def test_typed_csv_and_parquet_footer(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a, b\n1, 2.5\n3,4\n")
    assert files.read_numeric_csv(spark, str(tmp_path / "n.csv")).agg(F.sum("b")).first()[0] == 6.5
    for bad in ("x", "", "nan"):
        (tmp_path / "n.csv").write_text(f"a,b\n1,2\n{bad},4\n")
        with pytest.raises(Exception, match="(?i)malformed|finite"):
            files.read_numeric_csv(spark, str(tmp_path / "n.csv")).collect()
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "p"))
    got = files.inspect_parquet(spark, str(tmp_path / "p"))
    assert (got["rows"], got["row_groups"], got["target"], len(got["preview"])) == (100, 1, "id", 20)


def test_overflow_of_targets(spark):
    df = spark.range(200).select(F.col("id").alias("y"), F.lit(1.0).alias("x"), F.lit("train").alias("split"))
    r = profile.numeric_scan(df, "y").first()
    assert r.overflow and r.targets == [] and r.stds == {"x": 1.0}


def test_text_contexts(spark):
    df = spark.createDataFrame([("a",), ("ü",), (None,)], "c string")
    got = [r.k for r in df.select(context_key(F.col("c"), b"tag").alias("k")).collect()]
    wrap = lambda u: u - (1 << 64) if u >> 63 else u
    assert got == [wrap(blake2b_long("a".encode(), b"tag")), wrap(blake2b_long("ü".encode(), b"tag")), None]


def test_layers_learn_what_lines_cannot(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (600, 2))
    rows = spark.createDataFrame([(v.tolist(), float(v[0] * v[1] > 0)) for v in x], "features array<double>, label double")
    out = layers.predict_layers(layers.fit_layers(rows, 2, 2, (12,), 200), rows)
    assert metrics.multiclass_metrics(out, "label", "prediction").first()["accuracy"] > 0.9


def test_demo(spark):
    assert demo(spark).count() == 2400 and demo(spark).columns[-1] == "target"
