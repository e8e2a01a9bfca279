"""Numbers: parsing, vector kernels and activations as column expressions.

Everything here is a ``Column -> Column`` function of built-in expressions, so it stays
in the JVM and in generated code where Spark generates any.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decimal number. Spark would also read ``1d``, hexadecimal and infinity names.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BLANKS = " \t\n\x0b\x0c\r"


def text(c: Column) -> Column:
    """A cell as trimmed text; null is empty. Booleans read ``True`` and ``False``."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")), F.lit(BLANKS))


def parse_number(c: Column) -> Column:
    """The finite number that a text is, else null."""
    t = text(c)
    x = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def parse_stream_number(c: Column) -> Column:
    """As parse_number, with no-break spaces dropped and a decimal comma allowed."""
    return parse_number(F.replace(F.replace(text(c), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")))


def integer_label(x: Column) -> Column:
    """A number as a label: without a fraction where it has none."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def sigmoid(z: Column, clip: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), z))))


def softmax(z: Column) -> Column:
    """Of an array, shifted by its largest value."""
    e = lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    total = F.aggregate(e(z), F.lit(0.0), lambda s, x: s + x)
    return F.transform(e(z), lambda x: x / total)


def argmax(p: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def axpy(a: Column, b: Column, scale: float) -> Column:
    """a + scale * b"""
    return F.zip_with(a, b, lambda x, y: x + y * F.lit(scale))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def clip(v: Column, limit: float) -> Column:
    """Values held within +-limit; unchanged for a limit that isn't a positive number."""
    if not 0 < limit < float("inf"):
        return v
    return F.transform(v, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def all_finite(v: Column) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def normalize(v: Column, means: Column, stds: Column) -> Column:
    return F.zip_with(F.zip_with(v, means, lambda x, m: x - m), stds, lambda x, s: x / s)


def weight_update(w: Column, gradient: Column, rate: float, decay: float = 0.0) -> Column:
    """w - rate * (gradient + decay * w)"""
    return F.zip_with(w, gradient, lambda x, g: x - F.lit(rate) * (g + F.lit(decay) * x))


def power_floor(v: Column) -> Column:
    """The largest power of two that is at most v, 2 at least."""
    bits = F.floor(F.log2(F.greatest(F.lit(2), v).cast("double")) + 1e-12).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)


def comma_list(c: Column) -> Column:
    """``"1, 2"`` as an array of integers."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x).cast("int"))
