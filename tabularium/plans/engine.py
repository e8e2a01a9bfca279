"""From a file to a trained model: inspect, plan, fit, fine-tune, infer."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.hashing import with_split
from tabularium.operators import guard, metrics, planners, prepare, profile
from tabularium.operators.train import RATES, Linear, RandomBatches
from tabularium.plans.catalog_store import Store
from tabularium.sources import files

#: Training rows that the driver holds at a time. Steps are the same whether all rows fit or not.
BLOCK_ROWS = 65_536
LEAST_EVAL = 8


@dataclass(frozen=True)
class Config:
    """Options of a run; ``None`` means that the plan decides."""

    target: str | None = None
    task: str | None = None
    profile: str | None = None
    batch: int | None = None
    ram_percent: int = 50
    max_steps: int = 400
    learning_rate: float | None = None
    weight_decay: float = 0.0
    stream: bool | None = None
    seed: int = 42
    policy: guard.Policy | None = None

    def set(self, **options) -> Config:
        return replace(self, **options)


@dataclass(frozen=True)
class Plan:
    """What a run will do, before anything is trained."""

    path: str
    target: str
    task: str
    rows: int
    columns: list[str]
    profile: str
    stream: bool
    batch: int
    safe_min: int
    safe_max: int
    interval: int
    learning_rate: float
    policy: guard.Policy
    warnings: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class Result:
    run_id: str
    plan: Plan
    model: Linear
    encoder: prepare.Encoder
    best_score: float
    best_step: int
    reason: str
    history: list[tuple[int, float]]
    test: dict

    @property
    def checkpoint(self) -> str:
        return self.model.to_json()


class Engine:
    """The engine on a session; ``workspace`` is a folder that executors and driver share."""

    def __init__(self, spark: SparkSession, workspace: str | None = None, config: Config | None = None, threads: int = 8, ram_gb: int = 32, vram_gb: int = 0):
        self.spark, self.config = spark, config or Config()
        self.hardware = (threads, ram_gb, vram_gb)
        self.store = Store(spark, workspace) if workspace else None

    def configure(self, **options) -> Engine:
        self.config = self.config.set(**options)
        return self

    def read(self, path: str) -> DataFrame:
        return files.read_folder(self.spark, path).drop("row_index") if "." not in path.rstrip("/").rpartition("/")[2] else files.read(self.spark, path)

    def inspect(self, path: str) -> dict:
        df = self.read(path)
        cols = profile.quick_profile(df, df.columns)
        cand = {c for c, p in cols.items() if 2 <= p["n_distinct"] <= profile.MAX_CATEGORIES or (p["is_numeric"] and p["n_distinct"] > 2)}
        return {"path": path, "columns": df.columns, "profile": cols, "candidates": [c for c in df.columns if c in cand], "target": profile.choose_target(df.columns), "preview": [r.asDict() for r in df.limit(20).collect()]}

    def _options(self, options: dict) -> Config:
        return self.config.set(**options)

    def plan(self, path: str | DataFrame, target: str | None = None, **options) -> Plan:
        c = self._options(options)
        df = self.read(path) if isinstance(path, str) else path
        target = target or c.target or profile.choose_target(df.columns)
        if target not in df.columns:
            raise ValueError(f"there is no column {target}")
        for name, (low, high) in {"ram_percent": (10, 95), "max_steps": (1, 10_000_000)}.items():
            if not low <= getattr(c, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        stream = bool(c.stream)
        t = profile.target_task(df, target, stream).first()
        task = c.task or t.task
        if task == "error":
            raise ValueError(f"{target} has {t.n_classes} classes")
        threads, ram, vram = self.hardware
        one = self.spark.range(1)
        name = c.profile or one.select(planners.profile(F.lit(threads), F.lit(ram), F.lit(vram))).first()[0]
        p = planners.batch_plan(F.lit(t.n_rows).cast("long"), F.lit(len(df.columns) - 1).cast("long"), F.lit(name), F.lit(ram), F.lit(c.ram_percent))
        row = one.select(p.alias("p")).select("p.*").first()
        batch, warnings = row.recommended, []
        if c.batch is not None:
            got = one.select(planners.manual_batch(F.lit(c.batch).cast("long"), F.struct(*(F.lit(v).alias(k) for k, v in row.asDict().items())), F.lit(name)).alias("b")).select("b.*").first()
            batch = got.applied
            if got.risk != "safe":
                warnings.append(f"a batch of {batch} is {got.risk}")
        policy = c.policy or (guard.REGRESSION if task == "regression" else guard.Policy())
        policy = replace(policy, max_steps=c.max_steps)
        shown = path if isinstance(path, str) else "<frame>"
        return Plan(shown, target, task, t.n_rows, df.columns, name, stream, batch, row.safe_min, row.safe_max, guard.evaluation_interval(c.max_steps), c.learning_rate or RATES.get(name, 0.035), policy, warnings)

    def plan_many(self, sources: list, **options) -> list[Plan]:
        return [self.plan(*(s if isinstance(s, tuple) else (s,)), **options) for s in sources]

    def split(self, rows: DataFrame, plan: Plan, seed: int) -> DataFrame:
        """Streams split by the row's number; in memory rows are ordered by a seeded hash and cut by sizes."""
        if plan.stream:
            return with_split(files.with_file_order(rows), F.col("row_index")).drop("row_index")
        n = rows.count()
        held = max(16, round(0.15 * n)) if n >= 64 else max(1, round(0.15 * n))
        numbered = rows.withColumn("__h", F.xxhash64(F.to_json(F.struct(*rows.columns)), F.lit(seed)))
        cuts = numbered.agg(F.percentile_approx("__h", [held / n, 2 * held / n], 100_000)).first()[0]
        return numbered.withColumn("split", F.when(F.col("__h") <= cuts[0], "validation").when(F.col("__h") <= cuts[1], "test").otherwise("train")).drop("__h")

    def fit(self, path: str | DataFrame, target: str | None = None, start: Linear | None = None, **options) -> Result:
        c = self._options(options)
        plan = self.plan(path, target, **options)
        df = self.read(path) if isinstance(path, str) else path
        split = self.split(df.where(F.col(f"`{plan.target}`").isNotNull()), plan, c.seed).persist()
        try:
            enc = prepare.fit_encoder(split.drop("split") if not plan.stream else split.where("split = 'train'").drop("split"), plan.target, plan.stream)
            rows = enc.transform(split, ("split",)).where("label is not null").persist()
            try:
                return self._train(plan, c, enc, rows, start)
            finally:
                rows.unpersist()
        finally:
            split.unpersist()

    def finetune(self, result: Result, path: str | DataFrame, **options) -> Result:
        """Continues from a result's model; it stays the best until a step beats it."""
        return self.fit(path, result.plan.target, start=result.model, **options)

    def fit_many(self, sources: list, **options) -> list[Result]:
        return [self.fit(*(s if isinstance(s, tuple) else (s,)), **options) for s in sources]

    def _train(self, plan: Plan, c: Config, enc: prepare.Encoder, rows: DataFrame, start: Linear | None) -> Result:
        run = f"run_{uuid.uuid4().hex[:12]}"
        counts = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
        if min(counts.get(s, 0) for s in ("train", "validation", "test")) < LEAST_EVAL:
            raise ValueError(f"a split has fewer than {LEAST_EVAL} rows: {counts}")
        parts = {s: rows.where(F.col("split") == s) for s in ("train", "validation", "test")}
        width = sum(f.width() for f in enc.features)
        mean, std = 0.0, 1.0
        if plan.task == "regression":
            mean, std = parts["train"].agg(F.avg("label"), F.stddev_pop("label")).first()
        model = start or Linear.zeros(plan.task, width, max(1, len(enc.classes)), mean or 0.0, std or 1.0)
        if model.weights.shape[1] != width:
            raise ValueError("the model was made for other features")
        drawn = RandomBatches(parts["train"], counts["train"], BLOCK_ROWS, c.seed)
        best, best_model, best_step, reason, history = None, model, 0, "max_steps", []
        if start is not None:
            best = self.evaluate(parts["validation"], model)[0]
        streak = plateau = hits = evals = step = 0
        p, batch = plan.policy, plan.batch
        while step < c.max_steps:
            todo = min(plan.interval, c.max_steps - step)
            model = drawn.train(model, todo, batch, plan.learning_rate, c.weight_decay)
            step += todo
            evals += 1
            score, _ = self.evaluate(parts["validation"], model)
            if not np.isfinite(score):
                reason = "quality_gate_invalid"
                break
            history.append((step, score))
            if c.batch is None:
                batch = guard.next_batch([x for _, x in history], batch, plan.safe_min, plan.safe_max, counts["train"])
            streak = streak + 1 if best is not None and score < best - p.margin else 0
            if best is None or score > best + p.min_improvement:
                best, best_model, best_step, plateau = score, model, step, 0
            else:
                plateau += 1
            hits = hits + 1 if score >= p.target else 0
            if streak >= p.degradation_patience:
                reason = "model_degradation"
                break
            if hits >= p.target_patience:
                reason = "target_reached"
                break
            if plateau > p.plateau_patience:
                reason = "early_stopping"
                break
        drawn.close()
        test = self.evaluate(parts["test"], best_model)[1]
        result = Result(run, plan, best_model, enc, float(best if best is not None else float("nan")), best_step, reason, history, test)
        if self.store:
            self.store.save("runs", run, {"status": "completed", "target": plan.target, "task": plan.task, "best_score": result.best_score, "best_step": best_step, "reason": reason, "test": test, "created_at": time.time(), "checkpoint": json.loads(result.checkpoint)})
            self.store.log("engine", "run.completed", {"run_id": run, "reason": reason})
        return result

    def evaluate(self, rows: DataFrame, model: Linear) -> tuple[float, dict]:
        """The score (accuracy or R2) and all metrics of held-out rows."""
        df = model.predict(rows)
        if model.task == "regression":
            m = metrics.regression_metrics(df, "label", "prediction").first().asDict()
            return float(m["r2"]), m
        if model.task == "binary_classification":
            scored = df.select(F.col("label").alias("truth"), F.get("probabilities", F.lit(1)).alias("p"))
            m = metrics.binary_metrics(scored).first().asDict() | scored.agg(metrics.log_loss(F.col("truth"), F.col("p")).alias("loss")).first().asDict() | {"roc_auc": metrics.roc_auc(scored).first()["auc"]}
            return float(m["accuracy"]), m
        m = metrics.multiclass_metrics(df, "label", "prediction").first().asDict() | metrics.multiclass_log_loss(df, "label", "probabilities").first().asDict()
        return float(m["accuracy"]), m

    def predict(self, result: Result, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Predictions for rows with the columns the encoder was fitted on; the target may be absent."""
        enc = result.encoder
        if enc.target not in df.columns:
            df = df.withColumn(enc.target, F.lit(enc.classes[0] if enc.classes else "0"))
        return result.model.predict(enc.transform(df, keep)).drop("label")

    def inference_check(self, result: Result, df: DataFrame, n: int = 16) -> dict:
        """Scores ``n`` rows one by one, times them, and checks that the model stays as it was."""
        before = result.checkpoint
        rows = result.encoder.transform(df).limit(n).persist()
        ms, right = [], 0
        for r in rows.collect():
            began = time.perf_counter()
            z = result.model.weights @ np.array(r.features) + result.model.bias
            guess = float(z[0] * result.model.target_std + result.model.target_mean) if result.plan.task == "regression" else float(z[0] >= 0) if len(z) == 1 else float(np.argmax(z))
            ms.append((time.perf_counter() - began) * 1000)
            right += guess == r.label
        table = self.spark.createDataFrame([(m,) for m in ms], "ms double")
        out = metrics.latency_summary(table).first().asDict()
        return out | {"correct": right, "accuracy": right / max(1, len(ms)), "unchanged": before == result.checkpoint}


def fit(spark: SparkSession, path: str | DataFrame, target: str | None = None, **options) -> Result:
    return Engine(spark).fit(path, target, **options)


