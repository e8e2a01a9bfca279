"""Datasets of a workspace: imported with a prepared table, or attached by reference."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators import guard, prepare, profile
from tabularium.operators.catalog import orphans
from tabularium.operators.train import Linear
from tabularium.plans.catalog_store import Store
from tabularium.sources import files

MAX_IMPORT_BYTES, MAX_MANIFEST_BYTES = 512 << 20, 10 << 20
CONTRACT = "tabularium-manifest/1"
#: What a run's record has when it doesn't say. Fixed values.
RUN_DEFAULTS = {
    "batch_mode": "auto", "batch_size": 32, "batch_min": 8, "batch_max": 64, "batch_risk": "safe", "seed": 42, "weight_decay": 0.0, "architecture": "auto",
    "min_improvement": 0.0005, "degradation_margin": 0.03, "degradation_patience": 3, "early_stopping_patience": 18, "target_patience": 3,
    "target_score": 0.92, "priority": "normal", "profile": "eco", "max_steps": 1000, "cpu": 30, "ram": 35, "gpu": 0, "loss": 0.0, "step": 0, "best_score": 0.0, "status": "draft",
}


class DatasetError(ValueError):
    """A dataset that can't be imported, attached or used."""


def _key(prefix: str, digest: str, target: str) -> str:
    return f"{prefix}_{digest[:12]}_{hashlib.sha256(target.encode()).hexdigest()[:4]}"


class Datasets:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def import_file(self, path: str, target: str | None = None) -> str:
        """Prepares a file of at most 512 MiB and keeps the prepared rows; the dataset's id.

        The same content with the same target is used again. The prepared table is
        written aside and named in the catalogue only when it is whole.
        """
        info = self.spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("sha256")).first()
        if info is None:
            raise DatasetError(f"{path} isn't a file")
        if info.length > MAX_IMPORT_BYTES:
            raise DatasetError("the file is larger than 512 MiB; attach it instead")
        if files.reader_for(path) == "npz":
            df, target = files.read_npz(self.spark, path), "label"
            x = df.select("row_index", *(F.col("features")[k].alias(f"x{k}") for k in range(len(df.first().features))), "label").drop("row_index")
            df = x
        else:
            df = files.read(self.spark, path)
        target = target or profile.choose_target(df.columns)
        if found := self.store.find_dataset(info.sha256, target):
            return found
        enc = prepare.fit_encoder(df, target)
        key = _key("ds", info.sha256, target)
        folder = f"{self.store.root}/prepared/{key}-{uuid.uuid4().hex}"
        enc.transform(df).write.parquet(folder)
        again = self.spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        if again != info.sha256:
            raise DatasetError("the file changed while it was read")
        manifest = {
            "source": path, "sha256": info.sha256, "size_bytes": info.length, "target": target, "task": enc.task, "rows": enc.rows, "skipped": enc.skipped, "classes": enc.classes,
            "features": enc.names(), "transformations": [asdict(f) for f in enc.features], "dropped": enc.dropped, "split_seed": 42, "prepared": folder, "created_at": time.time(),
        }
        self.store.save("datasets", key, manifest)
        self.store.log("engine", "dataset.import", {"dataset_id": key})
        return key

    def attach(self, path: str, target: str | None = None) -> str:
        """Registers a file or folder by reference; only its plan and fingerprint are kept."""
        df = files.read_folder(self.spark, path).drop("row_index") if "." not in path.rstrip("/").rpartition("/")[2] else files.read(self.spark, path)
        target = target or profile.choose_target(df.columns)
        mark = files.fingerprint(self.spark, path)
        key = _key("stream", mark, target)
        if self.store.get("datasets", key):
            return key
        task = profile.target_task(df, target, stream=True).first()
        if task.task == "error":
            raise DatasetError(f"{target} has {task.n_classes} classes")
        prof = profile.quick_profile(df, [c for c in df.columns if c != target], stream=True)
        numeric = sorted(c for c, p in prof.items() if p["is_numeric"])
        spec = {
            "path": path, "fingerprint": mark, "sha256": mark, "target": target, "task": task.task, "rows": task.n_rows, "columns": df.columns, "numeric": numeric,
            "categorical": [c for c in df.columns if c != target and c not in numeric], "hash_buckets": prepare.BUCKETS, "created_at": time.time(),
        }
        self.store.save("datasets", key, spec)
        return key

    def load(self, key: str) -> DataFrame:
        """The prepared rows of an import, or the rows of an attached source that hasn't changed."""
        spec = self.store.get("datasets", key)
        if spec is None:
            raise DatasetError(f"there is no dataset {key}")
        if "prepared" in spec:
            return self.spark.read.parquet(spec["prepared"])
        path = spec["path"]
        if files.fingerprint(self.spark, path) != spec["fingerprint"]:
            raise DatasetError(f"{path} has changed since it was attached")
        return files.read_folder(self.spark, path) if "." not in path.rstrip("/").rpartition("/")[2] else files.read(self.spark, path)

    def health(self) -> DataFrame:
        """Prepared folders that no record names."""
        known = self.store.table("datasets").select(F.regexp_extract(F.get_json_object("payload", "$.prepared"), r"([^/]+)$", 1).alias("folder"))
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.store.root}/prepared")
        return orphans(there.select(F.regexp_extract("path", r"/prepared/([^/]+)/", 1).alias("folder")).distinct(), known, "folder")

    def export_manifest(self) -> str:
        body = json.loads(self.store.export())
        raw = json.dumps(body, sort_keys=True)
        return json.dumps({"contract": CONTRACT, "created_at": time.time(), "sha256": hashlib.sha256(raw.encode()).hexdigest(), **body}, sort_keys=True)

    def import_manifest(self, raw: str) -> dict[str, int]:
        """Restores records: runs in flight become recoverable errors, unsafe or foreign paths are refused."""
        if len(raw.encode()) > MAX_MANIFEST_BYTES:
            raise DatasetError("the manifest is larger than 10 MiB")
        got = json.loads(raw)
        if got.get("contract") != CONTRACT:
            raise DatasetError("the manifest has another contract")
        body = {k: got[k] for k in ("datasets", "runs")}
        if hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest() != got.get("sha256"):
            raise DatasetError("the manifest's digest doesn't fit its content")
        for d in body["datasets"]:
            path = d.get("prepared")
            if path is not None:
                if ".." in path.split("/"):
                    raise DatasetError("a path leaves the workspace")
                self.spark.read.parquet(path).schema  # noqa: B018  must be there
            self.store.save("datasets", d.pop("id"), d)
        for r in body["runs"]:
            key = r.pop("id")
            self.store.save("runs", key, normal_run(r) | ({"termination_reason": "manifest_restore", "status": "error_recoverable"} if r.get("status") in guard.IN_FLIGHT else {}))
        return {k: len(v) for k, v in body.items()}


def normal_run(raw: dict) -> dict:
    """A run's record with defaults for what it lacks and today's names."""
    out = RUN_DEFAULTS | raw
    if "target_metric" in out:
        value = out.pop("target_metric")
        out["target_score"] = raw.get("target_score", value)
    return out


class Checkpoints:
    """Last and best models of runs, each a row of JSON with a digest."""

    def __init__(self, store: Store):
        self.store = store

    def record(self, run: str, model: Linear, kind: str = "last", **about) -> None:
        self.store.save("checkpoints", f"{run}.{kind}", {"run_id": run, "kind": kind, "model": model.to_json(), **about})

    def load(self, run: str, kind: str = "best", **expected) -> Linear:
        """A verified model; ValueError where digest or expectations differ."""
        got = self.store.get("checkpoints", f"{run}.{kind}")
        if got is None:
            raise ValueError(f"there is no {kind} checkpoint of {run}")
        for k, v in expected.items():
            if got.get(k) != v:
                raise ValueError(f"the checkpoint's {k} is {got.get(k)}")
        return Linear.from_json(got["model"])

    def promote(self, run: str, **about) -> None:
        """The last model becomes the best one."""
        self.record(run, self.load(run, "last"), "best", **about)

    def discard_last(self, run: str) -> None:
        self.store.delete("checkpoints", f"{run}.last")


def demo(spark: SparkSession, rows: int = 2400, seed: int = 42) -> DataFrame:
    """A made-up binary task of four normal features."""
    x = [F.randn(seed + k) for k in range(4)]
    df = spark.range(rows).select(*(v.alias(f"feature_{k + 1}") for k, v in enumerate(x)), (F.randn(seed + 9) * 0.7).alias("noise"))
    return df.select("feature_1", "feature_2", "feature_3", "feature_4", (1.5 * F.col("feature_1") - F.col("feature_2") + 0.55 * F.col("feature_3") + F.col("noise") > 0).cast("int").alias("target"))
