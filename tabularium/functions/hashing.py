"""Hashes that decide splits, chunks and feature buckets.

64-bit arithmetic modulo 2^64 is done in halves of 32 and 16 bits, as Spark's signed
longs raise on overflow under ANSI rules. It takes several steps, each a projection:
Spark keeps them apart (an expression used twice isn't inlined) and still generates
one loop for them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SplitMix64's increment and multipliers. Fixed values.
GAMMA, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
LOW32 = 0xFFFFFFFF
SPLITS = ("train", "validation", "test")


def _lo(v: Column) -> Column:
    return v.bitwiseAND(F.lit(LOW32))


def _hi(v: Column) -> Column:
    return F.shiftrightunsigned(v, 32)


def _join(hi: Column, lo: Column) -> Column:
    return F.shiftleft(_lo(hi), 32).bitwiseOR(lo)


def _low32_of_product(x: Column, k: int) -> Column:
    """x * k modulo 2^32, give or take multiples of 2^32, for x below 2^32."""
    return x * F.lit(k & 0xFFFF) + ((x * F.lit(k >> 16)).bitwiseAND(F.lit(0xFFFF))) * F.lit(1 << 16)


def _times(df: DataFrame, v: str, k: int) -> DataFrame:
    """Replaces column v by v * k modulo 2^64."""
    ch, cl = k >> 32, k & LOW32
    lo = _lo(F.col(v))
    df = df.withColumns({f"{v}_p0": lo * F.lit(cl & 0xFFFF), f"{v}_p1": lo * F.lit(cl >> 16), f"{v}_h": _low32_of_product(lo, ch) + _low32_of_product(_hi(F.col(v)), cl)})
    p0, p1 = F.col(f"{v}_p0"), F.col(f"{v}_p1")
    df = df.withColumn(f"{v}_l", _lo(p0) + p1.bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16))
    df = df.withColumn(f"{v}_h", F.col(f"{v}_h") + _hi(p0) + F.shiftrightunsigned(p1, 16) + _hi(F.col(f"{v}_l")))
    return df.withColumn(v, _join(F.col(f"{v}_h"), _lo(F.col(f"{v}_l")))).drop(f"{v}_p0", f"{v}_p1", f"{v}_l", f"{v}_h")


def with_mix64(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Adds SplitMix64's finaliser of ``key`` (a long, taken as unsigned), as a signed long."""
    v = f"__{name}"
    low = _lo(F.col(v)) + F.lit(GAMMA & LOW32)
    df = df.withColumn(v, key.cast("long"))
    df = df.withColumn(f"{v}_s", low)
    df = df.withColumn(v, _join(_hi(F.col(v)) + F.lit(GAMMA >> 32) + _hi(F.col(f"{v}_s")), _lo(F.col(f"{v}_s")))).drop(f"{v}_s")
    for shift, k in ((30, MIX1), (27, MIX2)):
        df = df.withColumn(v, F.col(v).bitwiseXOR(F.shiftrightunsigned(F.col(v), shift)))
        df = _times(df, v, k)
    # The generator is a fence: a later filter on the hash would otherwise be pushed below
    # all steps, each written out as often as the next one uses it.
    return df.withColumn(name, F.explode(F.array(F.col(v).bitwiseXOR(F.shiftrightunsigned(F.col(v), 31))))).drop(v)


def unsigned_mod(v: Column, n: int) -> Column:
    """A signed long, taken as unsigned, modulo a small n."""
    half = F.shiftrightunsigned(v, 1)
    return ((half % F.lit(n)) * 2 + v.bitwiseAND(F.lit(1))) % F.lit(n)


def with_split(df: DataFrame, key: Column, name: str = "split", validation: int = 15, test: int = 15) -> DataFrame:
    """Adds the split of a key: buckets below ``validation`` percent, then ``test`` percent, then train.

    All rows of a key get the same split, whatever order or partition they are in.
    """
    if validation < 0 or test < 0 or validation + test > 95:
        raise ValueError("validation and test take 0 to 95 percent together")
    bucket = unsigned_mod(F.col("__mix"), 100)
    return (
        with_mix64(df, key, "__mix")
        .withColumn("__bucket", bucket)
        .withColumn(name, F.when(F.col("__bucket") < validation, "validation").when(F.col("__bucket") < validation + test, "test").otherwise("train"))
        .drop("__mix", "__bucket")
    )


def blake2b_long(value: bytes, person: bytes = b"") -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8, person=person).digest(), "little")


def feature_buckets(values: DataFrame, col: str, buckets: int = 64) -> DataFrame:
    """(value, bucket) for the distinct values of a column: blake2b of 8 bytes modulo ``buckets``.

    Spark has no blake2b, so distinct values pass through Python in Arrow batches; rows
    get their bucket by a join on the value.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(bucket=[blake2b_long(v.encode()) % buckets for v in b["value"]])

    return values.select(F.col(col).cast("string").alias("value")).where("value is not null").distinct().mapInPandas(run, "value string, bucket long")


def context_key(c: Column, person: bytes = b"") -> Column:
    """The long of a context that isn't a number: blake2b of its text under a tag.

    An engine that tags its hashes splits texts alike only under the same tag.
    """

    @F.pandas_udf("long")
    def of(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            u = blake2b_long(str(v).encode(), person)
            return u - (1 << 64) if u >> 63 else u

        return values.map(one).astype("Int64")

    return of(c.cast("string"))
