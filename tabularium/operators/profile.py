"""Column profiles, target choice and task inference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.numbers import parse_number, parse_stream_number, text

#: Names that mark a target column, and the most categories a column may have. Fixed values.
TARGET_NAMES = ("target", "label", "class", "y", "answer", "result")
MAX_CATEGORIES = 64
NUMERIC_SHARE = 0.95
CONSTANT_STD = 1e-12


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) with every cell as trimmed text, one row per cell."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), text(F.col(c)).alias("value")) for c in columns))
    return df.select(F.explode(cells).alias("c")).select("c.*")


def column_profile(df: DataFrame, columns: list[str] | None = None, stream: bool = False) -> DataFrame:
    """One row per column: n_rows, n_blank, n_numeric, n_distinct, ratio, is_numeric, nullable.

    The share of numbers is taken of the cells that aren't blank; of all cells under
    the rules for streams. One pass: cells are combined before the shuffle.
    """
    parse = parse_stream_number if stream else parse_number
    cells = unpivot(df, columns or df.columns).withColumn("x", parse(F.col("value")))
    out = cells.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("value") == "").alias("n_blank"),
        F.count("x").alias("n_numeric"),
        F.count_distinct(F.when(F.col("value") != "", F.col("value"))).alias("n_distinct"),
    )
    base = F.col("n_rows") if stream else F.col("n_rows") - F.col("n_blank")
    ratio = F.when(base > 0, F.col("n_numeric") / base).otherwise(F.lit(0.0))
    return out.withColumn("ratio", ratio).withColumn("is_numeric", (base > 0) & (F.col("ratio") >= NUMERIC_SHARE)).withColumn("nullable", F.col("n_blank") > 0)


def quick_profile(df: DataFrame, columns: list[str], stream: bool = False) -> dict[str, dict]:
    """As column_profile, by name, for wide or long tables: one aggregate that shuffles a row per task.

    n_distinct is a sketch's estimate; where that is at most four times the limit of
    categories it is counted exactly, in a second aggregate.
    """
    parse = parse_stream_number if stream else parse_number
    v = {c: text(F.col(f"`{c}`")) for c in columns}
    aggs = [a for c in columns for a in (F.count_if(v[c] == "").alias(f"{c}|blank"), F.count(parse(F.col(f"`{c}`"))).alias(f"{c}|num"), F.approx_count_distinct(F.when(v[c] != "", v[c])).alias(f"{c}|distinct"))]
    got = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    out = {}
    for c in columns:
        n, blank, num = got["n"], got[f"{c}|blank"], got[f"{c}|num"]
        base = n if stream else n - blank
        out[c] = {"n_rows": n, "n_blank": blank, "n_numeric": num, "n_distinct": got[f"{c}|distinct"], "ratio": num / base if base else 0.0, "is_numeric": bool(base) and num >= NUMERIC_SHARE * base, "nullable": blank > 0}
    few = [c for c in columns if out[c]["n_distinct"] <= 4 * MAX_CATEGORIES]
    if few:
        exact = df.agg(*(F.count_distinct(F.when(v[c] != "", v[c])).alias(c) for c in few)).first()
        for c in few:
            out[c]["n_distinct"] = exact[c]
    return out


def target_candidates(profile: DataFrame) -> DataFrame:
    """Columns that may be a target: 2 to 64 distinct values, or numbers with more than two."""
    few = F.col("n_distinct").between(2, MAX_CATEGORIES)
    return profile.select("column_name", "n_distinct", "is_numeric", (few | (F.col("is_numeric") & (F.col("n_distinct") > 2))).alias("candidate"))


def choose_target(columns: list[str]) -> str:
    """The first column with a target's name, else the last column."""
    return next((c for c in columns if c.strip().lower() in TARGET_NAMES), columns[-1])


def class_limit(n: int, stream: bool = False) -> int:
    """The most classes that whole-number targets may have before they count as measures."""
    most = max(20, math.isqrt(n) + 1)
    return min(MAX_CATEGORIES, most) if stream else most


def infer_task(n: Column, k: Column, n_numeric: Column, n_whole: Column, stream: bool = False) -> Column:
    """The task of a target from its counts of rows, distinct values, numbers and whole numbers."""
    limit = F.greatest(F.lit(20), F.floor(F.sqrt(n.cast("double"))).cast("long") + 1)
    numeric, whole = n_numeric == n, n_whole == n
    if stream:
        limit = F.least(F.lit(MAX_CATEGORIES), limit)
        return (
            F.when(k == 2, "binary_classification")
            .when(~numeric, F.when(k > MAX_CATEGORIES, "error").otherwise("multiclass_classification"))
            .when(whole & (k <= limit), "multiclass_classification")
            .otherwise("regression")
        )
    return (
        F.when(numeric & (k == 2), "binary_classification")
        .when(numeric & whole & (k > 2) & (k <= limit), "multiclass_classification")
        .when(numeric, "regression")
        .when((k < 2) | (k > MAX_CATEGORIES), "error")
        .when(k == 2, "binary_classification")
        .otherwise("multiclass_classification")
    )


def target_task(df: DataFrame, target: str, stream: bool = False) -> DataFrame:
    """(target, n_rows, n_classes, task); rows with a blank target don't count."""
    parse = parse_stream_number if stream else parse_number
    v = df.select(text(F.col(target)).alias("v")).where("v <> ''").withColumn("x", parse(F.col("v")))
    key = F.coalesce(F.col("x").cast("string"), F.col("v"))
    got = v.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_classes"), F.count("x").alias("nn"), F.count_if(F.col("x") == F.floor("x")).alias("nw")
    )
    return got.select(F.lit(target).alias("target"), "n_rows", "n_classes", infer_task(F.col("n_rows"), F.col("n_classes"), F.col("nn"), F.col("nw"), stream).alias("task"))


def class_index(df: DataFrame, target: str, numeric: bool = False) -> DataFrame:
    """(label, class_id, n): classes in order, by number or by text. There are few classes."""
    from pyspark.sql import Window

    key = parse_number(F.col("label")) if numeric else F.col("label")
    counts = df.select(text(F.col(target)).alias("label")).where("label <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", (F.row_number().over(Window.orderBy(key)) - 1).alias("class_id"), "n")


def dropped_columns(df: DataFrame, target: str) -> DataFrame:
    """(column_name, reason) of columns that can't be features: empty, leak or constant.

    A leak equals the target in every row. A constant has one value, or numbers whose
    deviation vanishes after blanks took the median. One aggregate over the table.
    """
    names = [c for c in df.columns if c != target]
    t = text(F.col(target))
    x = {c: parse_number(F.col(c)) for c in names}
    aggs = []
    for c in names:
        v = text(F.col(c))
        aggs += [
            F.count_if(v != "").alias(f"{c}|full"),
            F.bool_and(v == t).alias(f"{c}|leak"),
            F.count(x[c]).alias(f"{c}|num"),
            F.stddev_pop(x[c]).alias(f"{c}|std"),
            F.min(v).alias(f"{c}|min"),
            F.max(v).alias(f"{c}|max"),
        ]
    wide = df.where(t != "").agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"`{c}|{k}`").alias(k) for k in ("full", "leak", "num", "std", "min", "max"))) for c in names))
    numeric = (F.col("full") > 0) & (F.col("num") >= NUMERIC_SHARE * F.col("full"))
    reason = F.when(F.col("full") == 0, "empty").when(F.col("leak"), "leak").when(numeric & (F.col("std") <= CONSTANT_STD), "constant").when(~numeric & (F.col("min") == F.col("max")), "constant")
    return wide.select(F.explode(rows).alias("r")).select("r.*").select("column_name", reason.alias("reason")).where("reason is not null")


def numeric_scan(df: DataFrame, target: str, split: str = "split", most: int = 65) -> DataFrame:
    """One row about an all-numeric table: rows, rows of each split, training means and
    deviations by column, the target's sorted distinct texts and whether there are more
    than ``most`` of them.

    One aggregate for the numbers; distinct targets are combined in each task first and
    cut one above the limit.
    """
    names = [c for c in df.columns if c not in (target, split)]
    train = F.col(split) == "train"
    x = {c: F.when(train, parse_number(F.col(c))) for c in names}
    pairs = lambda f: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(f(x[c]) for c in names)))
    std = lambda c: F.when(F.stddev_pop(c) > CONSTANT_STD, F.stddev_pop(c)).otherwise(1.0)
    out = df.agg(
        F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(split) == s).alias(s) for s in ("train", "validation", "test")),
        pairs(F.avg).alias("means"), pairs(std).alias("stds"),
    )
    values = [r[0] for r in df.select(text(F.col(target)).alias("v")).distinct().limit(most + 1).collect()]
    kept = sorted(values) if len(values) <= most else []
    return out.withColumns({"targets": F.array(*map(F.lit, kept)).cast("array<string>"), "overflow": F.lit(len(values) > most)})
