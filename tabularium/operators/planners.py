"""Rule-based planners as column expressions: hardware profile, batch plan, execution tuner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabularium.functions.numbers import power_floor

MIB, GIB = 1 << 20, 1 << 30
#: Largest batch by profile. Fixed values.
PROFILE_CAPS = {"low-memory": 64, "eco": 64, "balanced": 256, "custom": 256, "performance": 512, "workstation": 65536}
#: Execution modes: share of threads, bulk step cap, arena bytes, data workers, prefetch, stream limit. Fixed values.
MODES = {
    "weak": (0.25, 8, 32 * MIB, 0, 0, 128 * MIB),
    "balanced": (0.5, 32, 96 * MIB, 2, 2, 256 * MIB),
    "performance": (0.75, 100, 256 * MIB, 6, 4, 384 * MIB),
    "workstation": (1.0, 100, 768 * MIB, 12, 8, 2**63 - 1),
}
#: Mode of each profile. Fixed values.
PROFILE_MODES = {"low-memory": "weak", "eco": "weak", "balanced": "balanced", "custom": "balanced", "performance": "performance", "workstation": "workstation"}


def _by(c: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def profile(threads: Column, ram_gb: Column, vram_gb: Column) -> Column:
    """The hardware profile that the rules recommend."""
    return (
        F.when((threads <= 6) | (ram_gb < 12), "low-memory")
        .when((threads >= 32) & (ram_gb >= 64) & ((vram_gb >= 16) | ((threads >= 64) & (ram_gb >= 128))), "workstation")
        .when((threads >= 16) & (ram_gb >= 32) & (vram_gb >= 8), "performance")
        .otherwise("balanced")
    )


def batch_plan(records: Column, features: Column, name: Column, ram_gb: Column, ram_percent: Column) -> Column:
    """A struct (train, safe_min, recommended, safe_max) for whole-number columns."""
    big = lambda x: F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint")
    whole = lambda x: F.floor(x).cast("bigint")
    validation = F.least(big(480), F.greatest(big(32), whole(records / 5)))
    train = F.greatest(big(2), records - validation)
    base = F.when(train < 64, 4).when(train < 256, 8).when(train < 1024, 16).when(train < 10_000, 32).when(train < 100_000, 64).otherwise(128).cast("bigint")
    base = F.when(features > 4096, F.greatest(big(2), whole(base / 4))).when(features > 512, F.greatest(big(2), whole(base / 2))).otherwise(base)
    workstation = name == "workstation"
    share = F.greatest(F.lit(10), F.least(F.lit(95), ram_percent)) / 100.0
    total = F.greatest(F.lit(1.0), ram_gb.cast("double")) * GIB
    reserve = F.when(workstation, F.greatest(F.lit(2.0 * GIB), total * 0.05)).otherwise(0.0)
    usable = F.greatest(F.lit(256.0 * MIB), F.least(total * share, total - reserve) * F.when(workstation, 0.80).otherwise(0.35))
    sample = F.greatest(big(2048), features * 48)
    memory = power_floor(F.greatest(big(2), whole(usable / sample)))
    dataset = power_floor(F.greatest(big(2), whole(train / 2)))
    safe_max = F.greatest(big(2), F.least(_by(name, PROFILE_CAPS).cast("bigint"), memory, dataset))
    recommended = F.least(safe_max, power_floor(base))
    safe_min = F.least(safe_max, F.greatest(big(2), whole(recommended / 2)))
    return F.struct(train.alias("train"), safe_min.alias("safe_min"), recommended.alias("recommended"), safe_max.alias("safe_max"))


def manual_batch(requested: Column, plan: Column, name: Column) -> Column:
    """A struct (applied, risk) for a batch size that was asked for."""
    hard = F.least(F.when(name == "workstation", 65536).otherwise(4096).cast("bigint"), plan["train"])
    applied = F.greatest(F.lit(1).cast("bigint"), F.least(hard, requested))
    risk = F.when(applied > plan["safe_max"], "high").when((applied < plan["safe_min"]) | (applied != plan["recommended"]), "caution").otherwise("safe")
    return F.struct(applied.alias("applied"), risk.alias("risk"))


def execution_plan(name: Column, threads: Column, batch: Column, features: Column) -> Column:
    """A struct (mode, threads, bulk_step_cap, arena_bytes, batch_bytes) of the tuner."""
    field = lambda k: _by(name, {p: MODES[m][k] for p, m in PROFILE_MODES.items()})
    used = F.greatest(F.lit(1), F.least(threads, F.bround(threads * field(0)).cast("int")))
    batch_bytes = (F.greatest(F.lit(1), batch) * F.greatest(F.lit(1), features + 1) * 4).cast("bigint")
    cap = field(2).cast("bigint")
    arena = F.least(cap, F.greatest(F.lit(8 * MIB).cast("bigint"), batch_bytes * 3, batch_bytes * 8, F.floor(cap / 4).cast("bigint")))
    return F.struct(_by(name, PROFILE_MODES).alias("mode"), used.alias("threads"), field(1).alias("bulk_step_cap"), arena.alias("arena_bytes"), batch_bytes.alias("batch_bytes"))


def resolved(explicit: Column, env: Column, config: Column, default: Column) -> Column:
    """A struct (value, source): the first setting that is given, and where it came from."""
    source = F.when(explicit.isNotNull(), "explicit").when(env.isNotNull(), "environment").when(config.isNotNull(), "config").otherwise("default")
    return F.struct(F.coalesce(explicit, env, config, default).alias("value"), source.alias("source"))


def record_estimate(known: Column, sampled: Column, size: Column, preview_bytes: Column, preview_count: Column) -> Column:
    """Rows of a file before it is read: known ones, or its size by the preview's bytes per row."""
    guess = F.floor(size / F.greatest(F.lit(1.0), preview_bytes / F.greatest(F.lit(1), preview_count))).cast("bigint")
    return F.coalesce(known.cast("bigint"), F.greatest(sampled.cast("bigint"), guess))
