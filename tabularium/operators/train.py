"""Linear models by exact gradient steps: an aggregate over the training rows per step."""

from __future__ import annotations

import json
import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.numbers import all_finite, argmax, dot, sigmoid, softmax
from tabularium.operators.order import with_ordinal

#: Default learning rates of linear models by hardware profile. Fixed values.
RATES = {"low-memory": 0.025, "balanced": 0.035, "performance": 0.04, "workstation": 0.04}


@dataclass
class Linear:
    """weights[class][feature] and bias[class]; one class for binary and regression models."""

    task: str
    weights: np.ndarray
    bias: np.ndarray
    target_mean: float = 0.0
    target_std: float = 1.0
    step: int = 0
    history: list[float] = field(default_factory=list)

    @classmethod
    def zeros(cls, task: str, features: int, classes: int = 1, target_mean: float = 0.0, target_std: float = 1.0) -> Linear:
        k = classes if task == "multiclass_classification" else 1
        return cls(task, np.zeros((k, features)), np.zeros(k), target_mean, target_std)

    def logits(self, x: str | Column = "features") -> Column:
        x = F.col(x) if isinstance(x, str) else x
        return F.array(*(dot(x, F.lit(w.tolist())) + float(b) for w, b in zip(self.weights, self.bias, strict=True)))

    def predict(self, df: DataFrame, x: str = "features") -> DataFrame:
        """Adds ``prediction`` (class or value) and, for classes, ``probabilities``."""
        z = self.logits(x)
        if self.task == "regression":
            return df.withColumn("prediction", F.get(z, F.lit(0)) * self.target_std + self.target_mean)
        if self.task == "binary_classification":
            p = sigmoid(F.get(z, F.lit(0)))
            out = df.withColumn("__p", p)
            return out.withColumns({"probabilities": F.array(1 - F.col("__p"), F.col("__p")), "prediction": (F.col("__p") >= 0.5).cast("double")}).drop("__p")
        out = df.withColumn("__z", z).withColumn("probabilities", softmax(F.col("__z"))).drop("__z")
        return out.withColumn("prediction", argmax(F.col("probabilities")).cast("double"))

    def to_json(self) -> str:
        body = {"task": self.task, "weights": self.weights.tolist(), "bias": self.bias.tolist(), "target_mean": self.target_mean, "target_std": self.target_std, "step": self.step}
        raw = json.dumps(body, sort_keys=True)
        return json.dumps({"model": body, "sha256": hashlib.sha256(raw.encode()).hexdigest()}, sort_keys=True)

    @classmethod
    def from_json(cls, raw: str) -> Linear:
        got = json.loads(raw)
        body = got["model"]
        if hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest() != got["sha256"]:
            raise ValueError("the checkpoint's digest doesn't fit its content")
        return cls(body["task"], np.array(body["weights"]), np.array(body["bias"]), body["target_mean"], body["target_std"], body["step"])


def step_error(model: Linear, x: Column, y: Column) -> tuple[list[Column], Column]:
    """Per class the error that a row's features are weighted with, and the row's loss."""
    z = [dot(x, F.lit(w.tolist())) + float(b) for w, b in zip(model.weights, model.bias, strict=True)]
    if model.task == "binary_classification":
        p = sigmoid(z[0])
        return [p - y], -(y * F.log(p + 1e-8) + (1 - y) * F.log(1 - p + 1e-8))
    if model.task == "multiclass_classification":
        top = F.greatest(*z)
        e = [F.exp(v - top) for v in z]
        total = sum(e[1:], e[0])
        errors = [v / total - (y == k).cast("double") for k, v in enumerate(e)]
        return errors, -F.log(F.get(F.array(*(v / total for v in e)), y.cast("int")) + 1e-8)
    e = z[0] - (y - model.target_mean) / model.target_std
    return [2 * e], e * e


def gradient(df: DataFrame, model: Linear, x: str = "features", y: str = "label") -> tuple[np.ndarray, np.ndarray, float, int]:
    """Mean gradients of weights and bias, mean loss and row count, in one job.

    Products are averaged by partial aggregation: what is shuffled is a row per task.
    """
    errors, loss = step_error(model, F.col(x), F.col(y))
    names = [f"__e{k}" for k in range(len(errors))]
    rows = df.select(x, *(e.alias(n) for e, n in zip(errors, names, strict=True)), loss.alias("__loss"))
    width = model.weights.shape[1]
    aggs = [F.avg(F.get(F.col(x), F.lit(j)) * F.col(n)) for n in names for j in range(width)]
    got = rows.agg(F.count(F.lit(1)), F.avg("__loss"), *(F.avg(n) for n in names), *aggs).first()
    k = len(names)
    if not got[0]:
        raise ValueError("there are no training rows")
    return np.array(got[2 + k :], float).reshape(k, width), np.array(got[2 : 2 + k], float), float(got[1]), got[0]


def train_step(df: DataFrame, model: Linear, rate: float, decay: float = 0.0, x: str = "features", y: str = "label") -> Linear:
    """One full-batch update; raises FloatingPointError for a loss that isn't finite."""
    gw, gb, loss, _ = gradient(df, model, x, y)
    if not np.isfinite(loss):
        raise FloatingPointError("the loss is no longer finite")
    return Linear(model.task, model.weights - rate * (gw + decay * model.weights), model.bias - rate * gb, model.target_mean, model.target_std, model.step + 1, [*model.history, loss])


def train(df: DataFrame, model: Linear, steps: int, rate: float, decay: float = 0.0) -> Linear:
    """Full-batch steps over rows that stay in memory or on disk between them."""
    df = df.persist()
    try:
        for _ in range(steps):
            model = train_step(df, model, rate, decay)
    finally:
        df.unpersist()
    return model


def minibatch(df: DataFrame, key: str, step: int, size: int, total: int, seed: int = 42) -> DataFrame:
    """About ``size`` of ``total`` rows, drawn for a step by a seeded hash of their key."""
    share = F.lit(min(1.0, size / max(1, total)))
    u = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(step), F.lit(seed)), 11) / float(1 << 53)
    return df.where(u < share)


def batch_steps(x: np.ndarray, y: np.ndarray, model: Linear, batch: int, rate: float, decay: float = 0.0) -> Linear:
    """A step for each run of ``batch`` rows, in order: many steps in one call."""
    w, b = model.weights.copy(), model.bias.copy()
    losses = []
    for lo in range(0, len(x), batch):
        xb, yb = x[lo : lo + batch], y[lo : lo + batch]
        z = xb @ w.T + b
        if model.task == "binary_classification":
            p = 1 / (1 + np.exp(-np.clip(z[:, 0], -30, 30)))
            e = (p - yb)[:, None]
            losses.append(float(-np.mean(yb * np.log(p + 1e-8) + (1 - yb) * np.log(1 - p + 1e-8))))
        elif model.task == "multiclass_classification":
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            losses.append(float(-np.log(p[np.arange(len(yb)), yb.astype(int)] + 1e-8).mean()))
            e = p.copy()
            e[np.arange(len(yb)), yb.astype(int)] -= 1
        else:
            r = z[:, 0] - (yb - model.target_mean) / model.target_std
            e = 2 * r[:, None]
            losses.append(float((r * r).mean()))
        w = w - rate * (e.T @ xb / len(xb) + decay * w)
        b = b - rate * e.mean(0)
    if not np.isfinite(losses).all():
        raise FloatingPointError("the loss is no longer finite")
    return Linear(model.task, w, b, model.target_mean, model.target_std, model.step + len(losses), [*model.history, *losses])


def draws(n: int, batch: int, steps: int, seed: int, first: int = 0) -> np.ndarray:
    """Places (step, row) of the random mini-batches, drawn with replacement; a step's don't depend on the others'."""
    return np.array([np.random.default_rng([seed, first + k]).integers(0, n, batch) for k in range(steps)]).reshape(steps, batch)


class RandomBatches:
    """Mini-batch steps on rows (features, label) by random places in their order.

    Rows are ordered by a hash of their values, so their places depend on nothing else.
    A table of at most ``held`` rows is held here; of a larger one each job fetches the
    rows that the next steps draw, ``held`` at most. The steps are the same either way.
    """

    def __init__(self, rows: DataFrame, n: int, held: int, seed: int = 42):
        self.n, self.held, self.seed = n, held, seed
        keyed = rows.select("features", "label", F.xxhash64("features", "label").alias("__h"))
        order = ["__h", "label", "features"]
        if n <= held:
            self.block, self.numbered = self._arrays(keyed.orderBy(*order).select("features", "label").toPandas()), None
        else:
            self.block, self.numbered = None, with_ordinal(keyed, order, "__place").drop("__h").persist()

    @staticmethod
    def _arrays(got) -> tuple[np.ndarray, np.ndarray]:
        return np.array(got["features"].tolist(), float), got["label"].to_numpy(float)

    def close(self) -> None:
        if self.numbered is not None:
            self.numbered.unpersist()

    def _drawn(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.block is not None:
            return self.block[0][at], self.block[1][at]
        wanted, back = np.unique(at, return_inverse=True)
        places = F.broadcast(self.numbered.sparkSession.createDataFrame([(int(k),) for k in wanted], "__place long"))
        got = self.numbered.join(places, "__place").toPandas().sort_values("__place")
        x, y = self._arrays(got)
        return x[back], y[back]

    def train(self, model: Linear, steps: int, batch: int, rate: float, decay: float = 0.0) -> Linear:
        """The model after ``steps`` more steps; its own step number is the cursor."""
        batch = min(batch, self.n)
        at_once = max(1, self.held // batch)
        for lo in range(0, steps, at_once):
            k = min(at_once, steps - lo)
            x, y = self._drawn(draws(self.n, batch, k, self.seed, model.step).ravel())
            model = batch_steps(x, y, model, batch, rate, decay)
        return model


def train_block(x: np.ndarray, y: np.ndarray, model: Linear, steps: int, batch: int, rate: float, decay: float = 0.0, seed: int = 42) -> Linear:
    """Many random mini-batch steps in one call on a block of rows that fits in memory.

    For bounded blocks only (at most 65,536 rows): the counterpart of a bulk dispatch.
    """
    if len(x) > 65_536:
        raise ValueError("a block has 65,536 rows at most")
    at = draws(len(x), batch, steps, seed)
    return batch_steps(x[at.ravel()], y[at.ravel()], model, batch, rate, decay)


def finite_rows(df: DataFrame, x: str = "features") -> DataFrame:
    """Rows whose features are all finite."""
    return df.where(all_finite(F.col(x)))
