"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a SQL condition under which a text is rejected. Its cost (seconds per row)
and its selectivity (share of rows rejected) are measured on a bounded sample; rules
then run in the order of rejection per cost, and a row leaves at its first rejection,
as the branches of one CASE. The order never changes a verdict, only what it costs.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the symbol count counts. Fixed values.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows of the sample on which cost and selectivity are estimated, and the bytes of the
#: longest text that takes part in it. The sample goes through the driver: 50 MB at most,
#: a few MB for texts of usual lengths.
SAMPLE_ROWS, SAMPLE_BYTES = 512, 100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Runs of other characters than space and \\t \\n \\v \\f \\r."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def n_symbols(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.octet_length(F.trim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that the text has twice or more.

    Windows are compared by 64-bit hashes. Only a text with an equal pair pays for the
    sort that tells which places are covered: equal windows are neighbours there, and
    their places in order cover min(width, distance to the next place) words each.
    """

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - width)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))

    def covered(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(F.get(s, i + 1), x) | same(F.get(s, i - 1), x))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            let(ordered, places),
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x
            ),
        )

    counted = let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(counted).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)`` is true for a text that the rule turns down."""

    name: str
    rejects: Callable[[Column, Column], Column]


#: The base rules of a document's verdict.
TOO_SHORT = Rule("too_short", lambda t, w: F.size(w) < 10)
REPEATS = Rule("repeats", lambda t, w: 100 * n_repeat_words(w) > 20 * F.size(w))
#: The rules beside them; their thresholds leave clean prose, lists and tables alone.
SYMBOL_HEAVY = Rule("symbol_heavy", lambda t, w: 10 * n_symbols(t) > F.size(w))
SHOUTING = Rule("shouting", lambda t, w: 10 * (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("!!"), F.lit("!")))) > F.size(w))
ODD_WORDS = Rule("odd_words", lambda t, w: (word_chars(w) > 20 * F.size(w)) | (word_chars(w) < 2 * F.size(w)))
STUTTER = Rule("stutter", lambda t, w: 10 * F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))) > 3 * F.size(w))
DUP_LINES = Rule("dup_lines", lambda t, w: 2 * n_dup_lines(t) > F.size(F.split(t, "\n")))
BASE = (TOO_SHORT, REPEATS)
EXTRA = (SYMBOL_HEAVY, SHOUTING, ODD_WORDS, STUTTER, DUP_LINES)


@dataclass(frozen=True)
class Ranked:
    rule: Rule
    seconds_per_row: float
    rejected: float
    rank: float = field(default=0.0)


def estimate(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, runs: int = 2) -> list[Ranked]:
    """Cost and selectivity of each rule on ``sample_rows`` rows, best rejection per cost first.

    The sample is the first rows that the scan gives, so only a few of its files are
    read; it is only for the order of the rules, which no verdict depends on. A rule's cost is the least time of ``runs``
    aggregates of its condition, less the time of one without a condition.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES)
    sample = docs.sparkSession.createDataFrame(texts.take(sample_rows), "t string").persist()

    def timed(what: Column) -> tuple[float, int, int]:
        best = float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            n, hits = sample.select(what.alias("x")).agg(F.count(F.lit(1)), F.count_if("x")).first()
            best = min(best, time.perf_counter() - began)
        return best, n, hits

    try:
        words = lambda body: let(words_of(F.col("t")), lambda w: body(F.col("t"), w))
        idle, n, _ = timed(words(lambda t, w: F.size(w) < 0))
        found = []
        for r in rules:
            took, _, hits = timed(words(r.rejects))
            cost, share = max(took - idle, 1e-4) / max(n, 1), hits / max(n, 1)
            found.append(Ranked(r, cost, share, share / cost))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x.rank, x.seconds_per_row))


def first_rejection(text: Column, words: Column, rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, in this order; null if none does.

    One CASE: a branch is evaluated only for rows that all earlier branches let pass.
    """
    out = F
    for r in rules:
        out = out.when(r.rejects(text, words), F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    A null or empty text has no words: it fails the base rules. Null ids and repeated
    rows keep their rows, other columns are ignored, an empty table gives no rows.
    """
    order = [x.rule for x in estimate(docs, extra, text_col)]
    text = F.col("t")

    def row(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            word_chars(w).alias("word_chars"),
            n_repeat_words(w).alias("n_repeat_words"),
            first_rejection(text, w, order).alias("why"),
        )

    out = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = out.select("i", n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"), let(words_of(text), row).alias("r"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        out.select(F.col("i").alias(id_col), "r.n_words", "r.word_chars", "n_symbols", "n_dup_lines", "r.n_repeat_words", "r.why")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.col("why").isNull())
        .drop("why")
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns they had.

    All rules take part in the cascade, so a row pays for the costly ones only if
    the cheap and selective ones let it pass. A null or empty text has no words and is
    rejected. Null ids and repeated rows are judged like any other; an empty table gives
    no rows.
    """
    order = [x.rule for x in estimate(docs, rules, text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.where(let(words_of(text), lambda w: first_rejection(text, w, order)).isNull())
