"""URL filters: host and path rules, then a character language-model ratio.

A url that a rule fits gets the rule's verdict. These urls also train two character
models, one of accepted and one of rejected urls: variable-order Markov models with
absolute discounting, each context backing off to the next shorter one. Other urls
are judged by the difference of the two log-likelihoods per character against a
threshold that is calibrated on a tenth of the ruled urls, kept out of training.

All counts of the other nine tenths are kept, in a table that is never collected:
the probabilities of the n-grams to score come from joins with it, one order after the
other, as an n-gram's probability follows from its counts and that of its suffix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.common import materialize, trimmed, utf8

#: (verdict, rule): a rule is a host and a path; it also fits the host's subdomains.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Longest context and discount.
ORDER, DISCOUNT = 5, 0.75
#: One in this many ruled urls calibrates the threshold; scores are binned this finely.
FOLD, BIN = 10, 0.005
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null and for one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null if none does."""
    out = verdict = F
    for what, rule in sorted(rules, key=lambda r: (-len(r[1]), r)):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + rest))
        out, verdict = out.when(fits, F.lit(rule)), verdict.when(fits, F.lit(what))
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return out.otherwise(F.lit(None)), verdict.otherwise(F.lit(None))


def _codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every character its last order + 1 characters in one number, and the text it is of."""
    sizes = np.array([len(t) for t in texts], np.int64)
    gap = bytes([2]) * order
    flat = np.frombuffer(gap + gap.join(texts), np.uint8).astype(np.int64) if len(texts) else np.empty(0, np.int64)
    own = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(int(sizes.sum())) + (own + 1) * order
    code = np.zeros(len(at), np.int64)
    for back in range(order, -1, -1):
        code = code << 8 | flat[at - back]
    return code, own


def _key(code: np.ndarray, k: int) -> np.ndarray:
    """The key of the last k + 1 characters: they and their number."""
    return code & ((1 << 8 * (k + 1)) - 1) | k << 56


def _context(key: np.ndarray) -> np.ndarray:
    """The key of an n-gram's context: all but its last character."""
    return ((key & ((1 << 56) - 1)) >> 8) | ((key >> 56) << 56)


def count_ngrams(ruled: DataFrame, order: int = ORDER) -> DataFrame:
    """(good, key, n): the n-grams of all orders in rows (good boolean, text string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            good, key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((key, good))
            good, key, n = good[by], key[by], n[by]
            new = np.r_[True, (key[1:] != key[:-1]) | (good[1:] != good[:-1])]
            return good[new], key[new], np.add.reduceat(n, np.flatnonzero(new))

        for b in batches:
            good = np.array(b.column(0).to_pylist(), bool)
            texts = utf8(b, "text")
            for flag in (False, True):
                code, _ = _codes([t for t, g in zip(texts, good, strict=True) if g == flag], order)
                for k in range(order + 1):
                    key, n = np.unique(_key(code, k), return_counts=True)
                    held.append((np.full(len(key), flag), key, n))
            if sum(len(x[1]) for x in held) > 2_000_000:
                held = [merged()]
                if len(held[0][1]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["good", "key", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["good", "key", "n"])

    return ruled.select("good", "text").mapInArrow(trimmed(run, 0), "good boolean, key long, n long").groupBy("good", "key").agg(F.sum("n").alias("n"))


@dataclass
class Markov:
    """One class's pruned counts: sorted keys of n-grams and of contexts."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Markov:
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by].astype(float)
        contexts, at = np.unique(_context(keys), return_inverse=True)
        totals = np.bincount(at, weights=counts, minlength=len(contexts))
        return cls(keys, counts, contexts, totals, np.bincount(at, minlength=len(contexts)).astype(float))

    def log2p(self, code: np.ndarray, order: int, discount: float) -> np.ndarray:
        """log2 P(character | longest known context) of each position."""
        p = np.full(len(code), 1 / 256)
        if not len(self.keys):
            return np.log2(p)
        for k in range(order + 1):
            key = _key(code, k)
            context = _context(key)
            c = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            known = self.contexts[c] == context
            g = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            n = np.where(self.keys[g] == key, self.counts[g], 0.0)
            q = (np.maximum(n - discount, 0) + discount * self.kinds[c] * p) / self.totals[c]
            p = np.where(known, q, p)
        return np.log2(p)


@dataclass
class Ratio:
    """Both models and the calibrated threshold."""

    good: Markov
    bad: Markov
    order: int = ORDER
    discount: float = DISCOUNT
    threshold: float = 0.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Log-likelihood difference in bits per character; 0 for an empty text."""
        code, own = _codes(texts, self.order)
        diff = self.good.log2p(code, self.order, self.discount) - self.bad.log2p(code, self.order, self.discount)
        size = np.maximum([len(t) for t in texts], 1) if texts else np.empty(0)
        return np.bincount(own, weights=diff, minlength=len(texts)) / size


def best_threshold(bins: list[tuple[int, bool, int]], width: float = BIN) -> float:
    """The lower edge of the bin from which on accepting gives the best mean of both classes' recalls."""
    good, bad = sum(n for _, g, n in bins if g), sum(n for _, g, n in bins if not g)
    if not good or not bad:
        return -np.inf if good else np.inf if bad else 0.0
    best, at = (1.0, 0.0), None
    passed_good, passed_bad = good, bad
    edges = sorted({b for b, _, _ in bins})
    by = {}
    for b, g, n in bins:
        by.setdefault(b, [0, 0])[g] += n
    best = None
    for e in [*edges, edges[-1] + 1]:
        value = passed_good / good - passed_bad / bad
        if best is None or (value, -abs(e)) > best:
            best, at = (value, -abs(e)), e
        n = by.get(e, [0, 0])
        passed_bad -= n[0]
        passed_good -= n[1]
    return at * width


def _scored(df: DataFrame, model: Ratio) -> DataFrame:
    """All columns of ``df`` (its last is ``text``), with the text's score instead of it."""
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                s = model.scores(utf8(part, "text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64())], names=schema.names)

    return df.mapInArrow(trimmed(run, 4096), schema)


def train(judged: DataFrame, order: int = ORDER, discount: float = DISCOUNT, *, max_ngrams: int) -> Ratio:
    """Models in memory, pruned to ``max_ngrams`` counts, and threshold from rows (text, ruled); ``judge`` doesn't prune."""
    ruled = judged.where(F.col("ruled").isNotNull()).select((F.col("ruled") == "allow").alias("good"), "text")
    fold = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(FOLD)) == 0
    counts = materialize(count_ngrams(ruled.where(~fold), order))
    sizes = sorted(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect(), reverse=True)
    kept = floor = 0
    for b, n in sizes:  # from the largest counts down
        kept += n
        if kept > max_ngrams:
            floor = 1 << (b + 1)
            break
    rows = counts.where(F.col("n") >= floor).select("key", "n", "good").toArrow()
    key, n, good = (rows.column(c).to_numpy() for c in ("key", "n", "good"))
    model = Ratio(Markov.of(key[good], n[good]), Markov.of(key[~good], n[~good]), order, discount)
    bins = _scored(ruled.where(fold), model).groupBy(F.floor(F.col("score") / BIN).cast("int").alias("b"), "good").count().collect()
    model.threshold = best_threshold([tuple(r) for r in bins])
    return model


def score_texts(texts: DataFrame, counts: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(text, score) of each distinct ``text`` but null, by all counts (good, key, n), as ``Ratio.scores`` gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, own = _codes(utf8(b, "text"), order)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(np.arange(len(own))), pa.array(code)], names=["text", "at", "code"])

    texts = materialize(texts.select("text").where("text IS NOT NULL").distinct())
    codes = materialize(texts.mapInArrow(trimmed(run), "text string, at long, code long"))
    every = materialize(codes.select("code").distinct())
    low = F.lit((1 << 56) - 1)
    context = F.shiftright(F.col("key").bitwiseAND(low), 8).bitwiseOR(F.shiftleft(F.shiftright("key", 56), 56)).alias("context")
    n = lambda flag: F.coalesce(F.sum(F.when(F.col("good") == flag, F.col("n"))), F.lit(0)).alias(f"n{flag:d}")
    grams = materialize(counts.groupBy("key").agg(n(True), n(False)))
    contexts = materialize(grams.groupBy(context).agg(*(f(k).alias(f"{x}{k}") for k in "10" for x, f in (("t", lambda k: F.sum(f"n{k}")), ("d", lambda k: F.count_if(F.col(f"n{k}") > 0))))))
    key_of = lambda k: F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).bitwiseOR(F.lit(k << 56))
    before = None
    for k in range(order + 1):
        suffix = key_of(k - 1) if k else F.lit(0).cast("long")
        rows = every.select(key_of(k).alias("key"), suffix.alias("suffix")).distinct().select("key", "suffix", context)
        rows = rows.join(grams, "key", "left").join(contexts, "context", "left")
        rows = rows.join(before, "suffix") if k else rows.withColumns({"p1": F.lit(1 / 256), "p0": F.lit(1 / 256)})

        def p(c: str) -> Column:
            seen = F.greatest(F.coalesce(F.col(f"n{c}"), F.lit(0)) - F.lit(discount), F.lit(0.0))
            return F.when(F.col(f"t{c}") > 0, (seen + discount * F.col(f"d{c}") * F.col(f"p{c}")) / F.col(f"t{c}")).otherwise(F.col(f"p{c}"))

        before = materialize(rows.select(F.col("key").alias("suffix"), p("1").alias("p1"), p("0").alias("p0")))
    diff = before.select(F.col("suffix").bitwiseAND(low).alias("code"), (F.log2("p1") - F.log2("p0")).alias("x"))
    whole = codes.join(diff, "code").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
    total = F.aggregate("xs", F.lit(0.0), lambda s, x: s + x["x"])
    sums = materialize(whole.select("text", (total / F.greatest(F.octet_length("text"), F.lit(1))).alias("score")))
    return texts.join(sums, "text", "left").select("text", F.coalesce("score", F.lit(0.0)).alias("score"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, score.

    The score is null where a rule decides. A url without a host and path (null, empty
    or without ``://``) can't be judged by its characters and is blocked. If the ruled
    urls are all of one class, the rest get that class's verdict; without any, all
    others are allowed. Null ids and repeated rows keep their rows; other columns are
    ignored; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("u"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")).select("id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), F.concat("host", "path").alias("text"))
    rows = materialize(rows)
    ruled_rows = rows.where(F.col("ruled").isNotNull()).select((F.col("ruled") == "allow").alias("good"), "text")
    fold = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(FOLD)) == 0
    counts = materialize(count_ngrams(ruled_rows.where(~fold)))
    scores = materialize(score_texts(rows.where(F.col("ruled").isNull() | fold), counts))
    bins = ruled_rows.where(fold).join(scores, "text").groupBy(F.floor(F.col("score") / BIN).cast("int").alias("b"), "good").count().collect()
    threshold = best_threshold([tuple(r) for r in bins])
    return rows.join(scores, "text", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruled", F.when((F.col("host") == "") & (F.col("path") == ""), "block").when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("score")).alias("score"),
    )
