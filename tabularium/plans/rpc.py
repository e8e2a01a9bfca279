"""A thin JSON-lines front end: one request a line, one answer a line."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from tabularium.plans.engine import Engine

MAX_BYTES = 1 << 20


def serve(engine: Engine, lines: Iterable[str]) -> Iterator[str]:
    """Answers {id, method, params} requests: ping, capabilities, inspect, plan, train."""
    for line in lines:
        if not line.strip():
            continue
        key = None
        try:
            if len(line.encode()) > MAX_BYTES:
                raise ValueError("the request is longer than 1 MiB")
            asked = json.loads(line)
            key = asked.get("id")
            params = asked.get("params") or {}
            method = asked.get("method")
            if method == "ping":
                result: object = "pong"
            elif method == "capabilities":
                result = {"tasks": ["binary_classification", "multiclass_classification", "regression"], "sources": ["csv", "tsv", "jsonl", "ndjson", "parquet", "pq", "npz"]}
            elif method == "inspect":
                result = engine.inspect(**params)
            elif method == "plan":
                result = engine.plan(**params).to_dict()
            elif method == "train":
                r = engine.fit(**params)
                result = {"run_id": r.run_id, "best_score": r.best_score, "best_step": r.best_step, "reason": r.reason, "test": r.test}
            else:
                raise ValueError(f"there is no method {method}")
            yield json.dumps({"id": key, "result": result}, default=str)
        except Exception as e:  # every request gets an answer
            yield json.dumps({"id": key, "error": f"{type(e).__name__}: {e}"})
