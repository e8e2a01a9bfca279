"""Fitted preparation: imputation, standardisation, one-hot and hashed categories."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.functions.hashing import feature_buckets
from tabularium.functions.numbers import parse_number, parse_stream_number, text
from tabularium.operators.profile import MAX_CATEGORIES, dropped_columns, infer_task, quick_profile
from tabularium.operators.quantiles import brackets, exact_medians

MISSING = "<missing>"
LEAST_ROWS = 40
BUCKETS = 64


def number(df: DataFrame, c: str, stream: bool = False) -> Column:
    """A column's finite numbers: a typed column as it is, a text column parsed."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.NumericType):
        x = F.col(f"`{c}`").cast("double")
        return F.when(F.abs(x) < float("inf"), x) if isinstance(kind, (T.FloatType, T.DoubleType)) else x
    return (parse_stream_number if stream else parse_number)(F.col(f"`{c}`"))


def numeric_stats(df: DataFrame, columns: list[str], impute: bool = True, where: Column | None = None) -> DataFrame:
    """(feature, median, mean, std): exact median of the numbers, mean and deviation after imputation.

    Without ``impute`` there is no median, and blanks are left out of mean and deviation,
    as for streams, where ``where`` keeps to training rows. A vanishing deviation reads 1.
    """
    if where is not None:
        df = df.where(where)
    x = {c: number(df, c) for c in columns}
    aggs = [f for c in columns for f in (F.count(x[c]).alias(f"{c}|k"), F.avg(x[c]).alias(f"{c}|a"), F.var_pop(x[c]).alias(f"{c}|v"))]
    got = df.agg(F.count(F.lit(1)).alias("n"), *aggs, *(brackets(x) if impute else [])).first()
    median = exact_medians(df, x, {c: got[f"{c}|k"] for c in columns}, {c: got[f"{c}|b"] for c in columns}) if impute else dict.fromkeys(columns)
    rows = []
    for c in columns:
        k, mean, var, m = got[f"{c}|k"], got[f"{c}|a"], got[f"{c}|v"], median[c]
        if impute and k:
            # With n - k blanks at the median the moments follow from those of the numbers.
            share, a = k / got["n"], mean
            mean = a * share + m * (1 - share)
            var = share * (var + (a - mean) ** 2) + (1 - share) * (m - mean) ** 2
        std = max(var or 0.0, 0.0) ** 0.5
        rows.append((c, m, mean, std if std > 1e-12 else 1.0))
    return df.sparkSession.createDataFrame(rows, "feature string, median double, mean double, std double")


def one_hot(c: Column, categories: list[str]) -> Column:
    """An array of 0 and 1, a place for each category; blanks are the category ``<missing>``."""
    v = F.when(text(c) == "", F.lit(MISSING)).otherwise(text(c))
    return F.array(*((v == k).cast("double") for k in categories))


def hot_bucket(bucket: Column) -> Column:
    """An array of ``BUCKETS`` values, 1 in the bucket's place; all 0 without a bucket."""
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: (i == F.coalesce(bucket, F.lit(-1))).cast("double"))


@dataclass
class Feature:
    """How one column becomes features."""

    column: str
    kind: str
    median: float = 0.0
    mean: float = 0.0
    std: float = 1.0
    categories: list[str] = field(default_factory=list)

    def width(self) -> int:
        return len(self.categories) if self.kind == "one_hot" else BUCKETS if self.kind == "feature_hash" else 1


@dataclass
class Encoder:
    """A fitted preparation: ``transform`` gives (keep columns, features, label)."""

    target: str
    task: str
    features: list[Feature]
    classes: list[str]
    dropped: dict[str, str]
    rows: int
    skipped: int
    stream: bool = False

    def names(self) -> list[str]:
        return [n for f in self.features for n in ([f"{f.column}={c}" for c in f.categories] if f.kind == "one_hot" else [f"{f.column}#{k}" for k in range(BUCKETS)] if f.kind == "feature_hash" else [f.column])]

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        parse = parse_stream_number if self.stream else parse_number
        parts, joined = [], df.where(text(F.col(self.target)) != "")
        for f in self.features:
            if f.kind == "one_hot":
                parts.append(one_hot(F.col(f.column), f.categories))
            elif f.kind == "feature_hash":
                name = f"__{f.column}_bucket"
                table = feature_buckets(joined, f.column).select(F.col("value").alias(f"{name}_v"), F.col("bucket").alias(name))
                joined = joined.join(table, F.col(f.column).cast("string") == F.col(f"{name}_v"), "left").drop(f"{name}_v")
                parts.append(hot_bucket(F.col(name)))
            elif self.stream:
                parts.append(F.array(F.coalesce((parse(F.col(f.column)) - f.mean) / f.std, F.lit(0.0))))
            else:
                parts.append(F.array((F.coalesce(parse(F.col(f.column)), F.lit(f.median)) - f.mean) / f.std))
        y = text(F.col(self.target))
        number = parse(F.col(self.target))
        if self.task == "regression":
            label = number
        else:
            known = F.array(*map(F.lit, self.classes))
            key = F.when(number == F.floor(number), F.floor(number).cast("bigint").cast("string")).otherwise(y) if all(_whole(c) for c in self.classes) else y
            label = (F.array_position(known, key) - 1).cast("double")
        return joined.select(*keep, F.concat(*parts).alias("features"), label.alias("label"))


def _whole(label: str) -> bool:
    return label.lstrip("+-").isdigit()


def fit_encoder(df: DataFrame, target: str, stream: bool = False, train: Column | None = None) -> Encoder:
    """Fits the preparation of all columns for a target.

    In memory mode statistics are of all rows and a text column may have 64 categories;
    in stream mode they are of training rows and text columns are hashed. What reaches
    the driver are a few numbers and at most 64 names a column.
    """
    names = [c for c in df.columns if c != target]
    n, skipped = df.agg(F.count_if(text(F.col(target)) != ""), F.count_if(text(F.col(target)) == "")).first()
    if n < LEAST_ROWS:
        raise ValueError(f"{n} rows have a target; {LEAST_ROWS} are needed")
    rows = df.where(text(F.col(target)) != "")
    dropped = {r.column_name: r.reason for r in dropped_columns(rows, target).collect()}
    usable = [c for c in names if c not in dropped]
    if not usable:
        raise ValueError("no column is left as a feature")
    prof = quick_profile(rows, usable, stream)
    numeric = [c for c in usable if prof[c]["is_numeric"]]
    texts = [c for c in usable if c not in numeric]
    if stream:
        numeric.sort()
    stats = {r.feature: r for r in numeric_stats(rows, numeric, impute=not stream, where=train).collect()} if numeric else {}
    made = {c: Feature(c, "median_impute_standardize" if not stream else "standardize", float(stats[c].median or 0.0), float(stats[c].mean or 0.0), float(stats[c].std)) for c in numeric}
    if stream:
        made |= {c: Feature(c, "feature_hash") for c in texts}
    elif texts:
        for c in texts:
            if prof[c]["n_distinct"] > MAX_CATEGORIES:
                raise ValueError(f"{c} has {prof[c]['n_distinct']} categories; {MAX_CATEGORIES} are the most")
        cells = F.array(*(F.struct(F.lit(c).alias("c"), F.when(text(F.col(f"`{c}`")) == "", F.lit(MISSING)).otherwise(text(F.col(f"`{c}`"))).alias("v")) for c in texts))
        found = rows.select(F.explode(cells).alias("x")).select("x.c", "x.v").distinct().collect()  # at most 65 a column
        made |= {c: Feature(c, "one_hot", categories=sorted(r.v for r in found if r.c == c)) for c in texts}
    order = [*numeric, *texts] if stream else usable
    parse = parse_stream_number if stream else parse_number
    y, x = text(F.col(target)), parse(F.col(target))
    task = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce(x.cast("string"), y)).alias("k"), F.count(x).alias("a"), F.count_if(x == F.floor(x)).alias("b"))
    task = task.select(infer_task(F.col("n"), F.col("k"), F.col("a"), F.col("b"), stream)).first()[0]
    if task == "error":
        raise ValueError(f"{target} has too few or too many classes")
    classes: list[str] = []
    if task != "regression":
        label = F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(y)
        classes = [r[0] for r in rows.select(label).distinct().limit(MAX_CATEGORIES * 64 + 1).collect()]
        if len(classes) > MAX_CATEGORIES * 64:
            raise ValueError(f"{target} has more than {MAX_CATEGORIES * 64} classes")
        classes.sort(key=(lambda c: (float(c), c)) if not stream and all(_whole(c) for c in classes) else str)
    return Encoder(target, task, [made[c] for c in order], classes, dropped, n, skipped, stream)
