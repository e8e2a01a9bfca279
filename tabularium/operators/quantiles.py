"""Exact medians of many columns without sorting or gathering them.

An approximate quantile sketch brackets each median; one pass then counts what lies
below the bracket and how often each value in it occurs, and the median follows. The
bracket holds about a thousandth of the rows; for tables so large that even this is
much, it is narrowed by further sketches first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketch accuracy, half width of the bracket in ranks, rows that a bracket may hold.
ACCURACY, HALF, MOST = 10_000, 5e-4, 500_000


def brackets(columns: dict[str, Column]) -> list[Column]:
    """Aggregates (array of low and high) that hold each median between them."""
    return [F.percentile_approx(x, [0.5 - HALF, 0.5 + HALF], ACCURACY).alias(f"{c}|b") for c, x in columns.items()]


def exact_medians(df: DataFrame, columns: dict[str, Column], counts: dict[str, int], bracket: dict[str, list[float]]) -> dict[str, float | None]:
    """The mean of the middle two values of each column; None for a column without values.

    ``counts`` are the columns' values that aren't null, ``bracket`` what ``brackets`` gave.
    """
    out: dict[str, float | None] = {c: None for c in columns if not counts[c]}
    open_ = {c: list(map(float, bracket[c])) for c in columns if counts[c]}
    while wide := [c for c in open_ if counts[c] * 2 * (HALF + 1 / ACCURACY) > MOST and open_[c][0] < open_[c][1]]:
        got = df.agg(
            *(F.count_if(columns[c] < open_[c][0]).alias(f"{c}|n") for c in wide),
            *(F.count_if(columns[c].between(*open_[c])).alias(f"{c}|k") for c in wide),
            *(F.percentile_approx(F.when(columns[c].between(*open_[c]), columns[c]), [k / 1000 for k in range(1, 1000)], ACCURACY * 10).alias(f"{c}|q") for c in wide),
        ).first()
        narrowed = False
        for c in wide:
            below, inside, cuts = got[f"{c}|n"], got[f"{c}|k"], got[f"{c}|q"]
            if inside <= MOST:
                continue
            # The median's place among the values inside, and the cuts two before and behind it.
            at = (counts[c] / 2 - below) / inside * 1000
            low, high = int(at) - 3, int(at) + 3
            new = [float(cuts[low]) if low >= 0 else open_[c][0], float(cuts[high]) if high < len(cuts) else open_[c][1]]
            narrowed |= new != open_[c]
            open_[c] = new
        if not narrowed:
            break
    if not open_:
        return out
    cells = F.array(*(F.struct(F.lit(c).alias("c"), F.when(columns[c] < lo, float("-inf")).when(columns[c] <= hi, columns[c]).alias("v")) for c, (lo, hi) in open_.items()))
    rows = df.select(F.explode(cells).alias("x")).where("x.v is not null").groupBy("x.c", "x.v").count().collect()
    for c in open_:
        seen, n, found = 0, counts[c], []
        for r in sorted((r for r in rows if r.c == c), key=lambda r: r.v):
            for rank in ((n - 1) // 2, n // 2)[len(found) :]:
                if seen <= rank < seen + r["count"]:
                    found.append(r.v)
            seen += r["count"]
        out[c] = (found[0] + found[1]) / 2
    return out
