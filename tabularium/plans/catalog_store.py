"""The workspace's append-only tables: datasets, runs and actions."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators import catalog

VERSION = "id string, updated_at double, deleted boolean, payload string"
ACTION = "id string, at double, actor string, action string, payload string"
SCHEMA_VERSION = 1


class Store:
    """Versions are appended as Parquet rows; the last one of an id is its state."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, name: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).write.mode("append").parquet(f"{self.root}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def save(self, kind: str, key: str, payload: dict) -> None:
        self._append(kind, (key, time.time(), False, json.dumps(payload | {"schema_version": SCHEMA_VERSION}, sort_keys=True)), VERSION)

    def delete(self, kind: str, key: str) -> None:
        if self.get(kind, key) is None:
            raise KeyError(key)
        self._append(kind, (key, time.time(), True, "{}"), VERSION)

    def table(self, kind: str) -> DataFrame:
        return catalog.latest(self._read(kind, VERSION), "id", "updated_at", "deleted").drop("deleted")

    def get(self, kind: str, key: str) -> dict | None:
        row = self.table(kind).where(F.col("id") == key).first()
        return json.loads(row.payload) if row else None

    def page(self, kind: str, limit: int = 100, offset: int = 0, status: str | None = None) -> DataFrame:
        t = self.table(kind)
        if status is not None:
            t = t.where(F.get_json_object("payload", "$.status") == status)
        return catalog.page(t, [F.desc("updated_at"), F.col("id")], limit, offset)

    def log(self, actor: str, action: str, payload: dict) -> None:
        self._append("actions", (uuid.uuid4().hex, time.time(), actor, action, json.dumps(payload, sort_keys=True)), ACTION)

    def actions(self) -> DataFrame:
        return self._read("actions", ACTION)

    def run_log(self, run: str, n: int = 100) -> DataFrame:
        return catalog.recent(self.actions().where(F.get_json_object("payload", "$.run_id") == run), n, "at")

    def find_dataset(self, digest: str, target: str) -> str | None:
        t = self.table("datasets")
        same = (F.get_json_object("payload", "$.sha256") == digest) & (F.get_json_object("payload", "$.target") == target)
        row = t.where(same).orderBy("updated_at").first()
        return row.id if row else None

    def export(self) -> str:
        """The tables' latest versions as one JSON text."""
        return json.dumps({k: [json.loads(r.payload) | {"id": r.id} for r in self.table(k).collect()] for k in ("datasets", "runs")}, sort_keys=True)
