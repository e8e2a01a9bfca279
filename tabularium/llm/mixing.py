"""Mixing sources to target weights by iterative proportional fitting.

The corpus is a table of token counts by source, language and topic. Raking multiplies
each cell by a factor of its source, one of its language and one of its topic until
the weighted tokens meet the target share of every source, language and topic.
Documents are then sampled: a document's chance is its cell's factor times a common
scale, which is set so that the expected tokens are the wanted share of all tokens.
Where a chance would exceed 1, the factors are fitted again under that bound: cells
at 1 stay there and the others make up for them, until the expected sample itself meets
the targets. A source, language or topic whose target is more than all it has is taken
whole and the others share the rest; that, and a fit that stays off its targets, is
warned of.

A document's topic and token count are columns of the table where it has them. Else the
tokens are words and an end mark, and topics are clusters: spherical k-means over hashed
tf-idf vectors of all distinct texts, to which every document is then assigned.

Sources may be many; languages and topics are few. So a source is a row that holds its
cells, its factor follows from the row alone, and an iteration is one aggregate to a
languages-by-topics matrix, the only thing the driver sees. Cells are summed before
the shuffle, so a hot source costs no more rows than any other.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.common import materialize, trimmed

#: Topics, dimensions of a text's vector, and rounds of the fit.
TOPICS, DIMENSIONS, FIT_ROUNDS = 8, 512, 25
#: An entry of a text's vector, and of its unit vector in whole parts of one.
ENTRY, WHOLE = np.dtype([("at", "<u2"), ("w", "<f8")]), 1 << 24
PART = np.dtype([("at", "<u2"), ("w", "<i4")])
#: Rows of a matrix product: so few that BLAS doesn't spread one over threads, which would wait for each other.
PRODUCT_ROWS = 64
#: Cells of languages and topics, and sources whose factors are broadcast; more languages
#: raise, more sources are joined by a shuffle.
MOST_CELLS, MOST_BROADCAST = 100_000, 100_000
#: Sources times cells up to which the raking's rounds run on the driver (8 MB), by the same function as Spark's tasks.
MOST_LOCAL = 1 << 20
#: The power of a marginal's token shares that is its target, and the
#: share of all tokens that the sample shall hold.
POWER, SHARE = 0.7, 0.7
ROUNDS, TOLERANCE = 100, 1e-9
#: A sample whose expected shares are further off than this is warned of.
OFF = 1e-4
SEED = 2024


def word_vector(words: list[bytes]) -> np.ndarray:
    """A text's entries (dimension by CRC32, sum of log(1 + count)) of its distinct words of four bytes or more."""
    own = {w: n for w, n in Counter(words).items() if len(w) > 3}
    at = np.fromiter(map(zlib.crc32, own), np.int64, len(own)) % DIMENSIONS
    v = np.bincount(at, weights=np.log1p(np.fromiter(own.values(), float, len(own))), minlength=DIMENSIONS)
    out = np.empty(np.count_nonzero(v), ENTRY)
    out["at"] = np.flatnonzero(v)
    out["w"] = v[out["at"]]
    return out


def flat(vectors: pa.BinaryArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of vectors without nulls: entries of each, and all entries' dimensions and numbers."""
    if not len(vectors):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ends = np.frombuffer(vectors.buffers()[1], "<i4")[vectors.offset : vectors.offset + len(vectors) + 1].astype(np.int64)
    data = np.frombuffer(vectors.buffers()[2] or b"", kind, (ends[-1] - ends[0]) // kind.itemsize, ends[0])
    return np.diff(ends) // kind.itemsize, data["at"].astype(np.int64), data["w"].astype(float)


def dense(n: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows of ``DIMENSIONS`` numbers of ``flat`` vectors."""
    out = np.zeros((len(n), DIMENSIONS))
    out.ravel()[np.repeat(np.arange(len(n)) * DIMENSIONS, n) + at] = w
    return out


def nearness(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """``x @ centres.T`` in one thread."""
    return np.concatenate([x[k : k + PRODUCT_ROWS] @ centres.T for k in range(0, len(x), PRODUCT_ROWS)] or [np.zeros((0, len(centres)))])


@dataclass
class Topics:
    """Centroids (topic, dimension) of unit length, already times the inverse document frequencies."""

    weights: np.ndarray

    def of(self, vector: np.ndarray) -> int:
        """The nearest centroid's number; of equally near ones the lowest, so 0 for a text without words."""
        return int((self.weights[:, vector["at"]] @ vector["w"]).round(9).argmax()) if len(vector) else 0


def unit_parts(vectors: pa.BinaryArray, idf: np.ndarray) -> pa.BinaryArray:
    """Vectors with entries, times the inverse document frequencies and of unit length, in whole parts."""
    n, at, w = flat(vectors, ENTRY)
    if not len(n):
        return vectors
    w = w * idf[at]
    starts = np.cumsum(n) - n
    out = np.empty(len(w), PART)
    out["at"] = at
    out["w"] = np.rint(w / np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), n) * WHOLE)
    ends = (np.append(starts, len(w)) * PART.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())])


def normed(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def draws(h: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the hashes ``h`` and the turn alone."""
    v = h.astype(np.int64).view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(times)
    return ((v ^ (v >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` with a text ``v``: its vector in its place, its hash ``h`` (null: null), words and an end mark as ``words``."""
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(SEED))))
    place = rows.columns.index("v")
    fields = [T.StructField(f.name, T.BinaryType()) if f.name == "v" else f for f in rows.schema.fields]
    schema = T.StructType([*fields, T.StructField("words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(t or b"").split() for t in b.column(place).cast(pa.binary()).to_pylist()]
            cols = b.columns
            cols[place] = pa.array([word_vector(w).tobytes() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(w) + 1 for w in words], pa.int64())], names=schema.names)

    return rows.mapInArrow(trimmed(run), schema)


def fit_topics(docs: DataFrame, text_col: str = "text", topics: int = TOPICS) -> Topics:
    """Clusters of all distinct texts."""
    return fit_vectors(measured(docs.select(F.col(text_col).alias("v"))), topics)


def fit_vectors(rows: DataFrame, topics: int = TOPICS) -> Topics:
    """Spherical k-means over the distinct texts of ``measured`` rows that have a word in their vector.

    Every pass reads all of them. What reaches the driver are sums by topic and dimension,
    of whole numbers, so that they don't depend on how rows are dealt, and a row a draw.
    Once document frequencies are known, unit vectors are written in whole parts, so that
    the passes after that only multiply and add.
    """
    texts = materialize(rows.where(F.col("h").isNotNull() & (F.length("v") > 0)).groupBy("h").agg(F.min("v").alias("v")))

    def sums(of: Callable[[pa.BinaryArray], np.ndarray], places: int) -> np.ndarray:
        """The sum of whole numbers ``of`` (places, DIMENSIONS) over all slices of texts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((places, DIMENSIONS), np.int64)
            for b in batches:
                total += of(b.column(0))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

        out = np.zeros(places * DIMENSIONS, np.int64)
        for r in texts.select("v").mapInArrow(trimmed(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = r.n
        return out.reshape(places, DIMENSIONS)

    def draw(centres: np.ndarray) -> np.ndarray | None:
        """A text's unit vector, drawn by its distance from the centres to the power of 2; None if all lie on one.

        Of exponential numbers at rates w the least is that of each row with chance w / sum(w).
        """
        turn = len(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for b in batches:
                if not b.num_rows:
                    continue
                h = b.column(0).to_numpy(zero_copy_only=False)
                far = 1 - nearness(normed(dense(*flat(b.column(1), PART))), centres).max(1) if turn else np.ones(len(h))
                key = np.where(far > 1e-9, -np.log(draws(h, turn)) / np.maximum(far, 1e-9).round(9) ** 2, np.inf)
                k = np.lexsort((h, key))[0]
                if key[k] < np.inf and (best is None or (key[k], h[k]) < best[:2]):
                    best = key[k], h[k], b.column(1)[int(k)].as_py()
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]], pa.float64()), pa.array([best[1]], pa.int64()), pa.array([best[2]], pa.binary())], names=["key", "h", "v"])

        got = texts.select("h", "v").mapInArrow(trimmed(run), "key double, h long, v binary").orderBy("key", "h").limit(1).collect()
        return normed(dense(*flat(pa.array([bytes(got[0].v)], pa.binary()), PART)))[0] if got else None

    n = texts.count()
    if not n:
        return Topics(np.zeros((1, DIMENSIONS)))
    idf = np.log((1 + n) / (1 + sums(lambda v: np.bincount(flat(v, ENTRY)[1], minlength=DIMENSIONS)[None], 1)[0])) + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), unit_parts(b.column(1), idf)], names=["h", "v"])

    texts = materialize(texts.select("h", "v").mapInArrow(trimmed(parts), "h long, v binary"))
    centres = np.zeros((0, DIMENSIONS))
    while len(centres) < topics and (new := draw(centres)) is not None:
        centres = np.vstack([centres, new])
    for _ in range(FIT_ROUNDS):

        def members(v: pa.BinaryArray, centres: np.ndarray = centres) -> np.ndarray:
            n, at, w = flat(v, PART)
            own = (nearness(dense(n, at, w), centres) / WHOLE).round(9).argmax(1)
            return np.bincount(np.repeat(own * DIMENSIONS, n) + at, weights=w, minlength=centres.size).astype(np.int64).reshape(centres.shape)

        total = sums(members, len(centres)).astype(float)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        new = np.where(size > 0, total / np.maximum(size, 1e-12), centres)
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return Topics(centres * idf)


def with_topics(rows: DataFrame, model: Topics) -> DataFrame:
    """``measured`` rows with ``topic`` (a string) in place of ``h`` and ``v``."""
    rows = rows.drop("h")
    place = rows.columns.index("v")
    schema = T.StructType([T.StructField("topic", T.StringType()) if f.name == "v" else f for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.columns
            cols[place] = pa.array([str(model.of(np.frombuffer(v, ENTRY))) for v in b.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(trimmed(run), schema)


def target_shares(tokens: np.ndarray, names: list, power: float, given: dict | None) -> np.ndarray:
    """A marginal's targets: the given shares, and for the rest what they leave, by tokens to the power."""
    given = given or {}
    fixed = np.array([given.get(n, np.nan) for n in names], float)
    free = np.isnan(fixed)
    tempered = np.where(free, np.power(np.maximum(tokens, 0), power), 0.0)
    left = max(0.0, 1 - np.nansum(fixed))
    out = np.where(free, left * tempered / max(tempered.sum(), 1e-300), fixed)
    return out / out.sum()


@dataclass
class Mix:
    """Fitted factors. ``sources`` is a table (source, factor, chance); the others are small.

    A chance is the product of a source's chance, ``lang_chances`` and ``topic_chances``,
    at most 1. ``error`` is by how much of all tokens the raked weights miss a target,
    ``sample_error`` by how much of its tokens the expected sample misses one.
    """

    sources: DataFrame
    langs: dict[str, float]
    topics: dict[str, float]
    scale: float
    rounds: int
    error: float
    lang_chances: dict[str, float]
    topic_chances: dict[str, float]
    sample_error: float


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def matrix(batch: pa.RecordBatch, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (n, want, cells of k and n): a row of ``places`` token counts each, their sums, the wanted tokens."""
    cells = batch.column(2)
    inner = cells.flatten()
    out = np.zeros((batch.num_rows, places))
    rows = np.repeat(np.arange(batch.num_rows), cells.value_lengths().to_numpy(zero_copy_only=False))
    out[rows, inner.field("k").to_numpy(zero_copy_only=False)] = inner.field("n").to_numpy(zero_copy_only=False)
    return out, batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)


class Folds:
    """Sums over the table of sources (n, want, cells), ``places`` pairs of language and topic each.

    Up to ``MOST_LOCAL`` numbers are read once and summed on the driver, as a Spark job a
    round costs more than the sum; more are summed by Spark's tasks, slice by slice. The
    functions summed are the same.
    """

    def __init__(self, sources: DataFrame, count: int, places: int):
        self.rows, self.places, self.slice = sources.select("n", "want", "cells"), places, max(1, MOST_LOCAL // places)
        self.own = None
        if count * places <= MOST_LOCAL:
            self.own = [matrix(b, places) for b in self.rows.toArrow().combine_chunks().to_batches()]

    def __call__(self, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of ``of`` (token counts, their sums, the wanted tokens) over all sources."""
        if self.own is not None:
            return sum(of(*x) for x in self.own)
        places = self.places

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    new = of(*matrix(b, places))
                    total = new if total is None else total + new
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "x"])

        got = self.rows.mapInArrow(trimmed(run, self.slice), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(len(got))
        for r in got:
            out[r["at"]] = r.x
        return out


def rake(cells: DataFrame, share: float = SHARE, power: float = POWER, source_shares: dict | None = None, lang_shares: dict | None = None, topic_shares: dict | None = None) -> Mix | None:
    """Fits (source, lang, topic, n) token counts to the marginals' targets; None without cells.

    Targets are shares of tokens: those given, the rest by tokens to the ``power``.
    """
    margin = cells.groupBy("lang", "topic").agg(F.sum("n").alias("n")).limit(MOST_CELLS + 1).collect()
    if len(margin) > MOST_CELLS:
        raise ValueError(f"there are more than {MOST_CELLS} pairs of language and topic")
    if not margin:
        return None
    langs, topics = sorted({r.lang for r in margin}), sorted({r.topic for r in margin})
    at_l, at_t = {x: k for k, x in enumerate(langs)}, {x: k for k, x in enumerate(topics)}
    tokens = np.zeros((len(langs), len(topics)))
    for r in margin:
        tokens[at_l[r.lang], at_t[r.topic]] = r.n
    total = tokens.sum()
    want_l = target_shares(tokens.sum(1), langs, power, lang_shares) * total
    want_t = target_shares(tokens.sum(0), topics, power, topic_shares) * total

    by_source = cells.groupBy("source").agg(
        F.collect_list(F.struct((_lookup(at_l, F.col("lang")) * len(topics) + _lookup(at_t, F.col("topic"))).alias("k"), F.col("n").cast("double").alias("n"))).alias("cells"),
        F.sum("n").cast("double").alias("n"),
    )
    given = {k: float(v) for k, v in (source_shares or {}).items()}
    fixed = _lookup(given, F.col("source")) if given else F.lit(None).cast("double")
    by_source = by_source.withColumn("given", fixed).withColumn("tempered", F.when(F.col("given").isNull(), F.pow("n", F.lit(power))).otherwise(0.0))
    by_source = materialize(by_source)
    free, taken, count = by_source.agg(F.sum("tempered"), F.coalesce(F.sum("given"), F.lit(0.0)), F.count(F.lit(1))).first()
    left = max(0.0, 1 - taken)
    whole = taken + (left if free else 0.0)
    want_s = F.coalesce("given", F.col("tempered") * left / max(free, 1e-300)) * total / whole
    by_source = by_source.select("source", "n", "cells", want_s.alias("want"))
    folds = Folds(by_source, count, tokens.size)

    b, c = np.ones(len(langs)), np.ones(len(topics))
    error, done = np.inf, 0
    for done in range(1, ROUNDS + 1):  # noqa: B007
        m = folds(lambda n, have, want, g=np.outer(b, c).ravel(): (want / (n @ g)) @ n).reshape(tokens.shape)
        # With this round's source factors the sources fit; how far are the others off?
        now = m * b[:, None] * c[None, :]
        error = max(np.abs(now.sum(1) - want_l).max(), np.abs(now.sum(0) - want_t).max()) / total
        if error < TOLERANCE:
            break
        b = want_l / np.maximum(m @ c, 1e-300)
        c = want_t / np.maximum(b @ m, 1e-300)
    g_of = F.lit(np.outer(b, c).ravel().tolist())
    inside = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["n"] * F.get(g_of, x["k"]))
    sources = materialize(by_source.withColumn("factor", F.col("want") / inside))
    g = F.col("factor") * F.get(g_of, F.col("x.k"))
    # Cells by their factors, in bins of a thousandth: enough to set the scale.
    bins = sources.select("factor", F.explode("cells").alias("x")).select(F.floor(F.log(g) * 1000).cast("long").alias("bin"), g.alias("g"), F.col("x.n").alias("n"))
    bins = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("g")).alias("w"), F.max("g").alias("most")).collect()
    n, w = np.array([r.n for r in bins]), np.array([r.w for r in bins])
    scale, most = scale_for(n, w, share * total), max((r.most for r in bins if r.most is not None), default=0.0)
    b2, c2, off, chances = b, c, float(error), sources.select("source", "factor", (F.col("factor") * scale).alias("chance"))
    if scale * most > 1 and share < 1:
        chances, b2, c2, off = bounded(sources, folds, tokens, want_l / total, want_t / total, share * total, b, c)
    if not max(off, float(error)) <= OFF:
        warnings.warn(f"mixing misses targets: the raked weights by {error:.2g}, the sample by {off:.2g} of its tokens", stacklevel=2)
    named = lambda keys, x: dict(zip(keys, x.tolist(), strict=True))
    return Mix(chances, named(langs, b), named(topics, c), scale, done, float(error), named(langs, b2), named(topics, c2), off)


def reachable(have: np.ndarray, shares: np.ndarray, wanted: float) -> np.ndarray:
    """Tokens to take of each name: ``wanted`` by the shares, at most what there is, the others sharing the rest."""
    pick = shares > 0
    out = np.zeros(len(have))
    out[pick] = np.minimum(have[pick], scale_for(have[pick], shares[pick], wanted) * shares[pick])
    return out


def _source_scale(folds: Folds, total: float, wanted: float) -> float:
    """``scale_for`` over the table of sources: Newton steps, which approach it from below."""
    s = wanted
    for _ in range(ROUNDS):

        def full(n: np.ndarray, have: np.ndarray, want: np.ndarray, s: float = s) -> np.ndarray:
            whole = want / total * s >= have
            return np.array([have[whole].sum(), want[~whole].sum() / total])

        taken, rest = folds(full)
        if rest <= 0 or abs(new := (wanted - taken) / rest) <= s * (1 + 1e-12):
            break
        s = new
    return s


def filled(n: np.ndarray, g: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each row of ``n`` the a with sum(n * min(1, a * g)) = wanted: its cells with the largest g are full first."""
    by = np.argsort(-g, kind="stable")
    by = by[g[by] > 0]
    n, g = n[:, by], g[by]
    left = wanted[:, None] - (np.cumsum(n, 1) - n)
    rest = np.cumsum((n * g)[:, ::-1], 1)[:, ::-1]
    a = left / np.maximum(rest, 1e-300)
    fits = (rest > 0) & (a * g <= 1) & (n > 0)
    least = np.where(n > 0, g, np.inf).min(1, initial=np.inf)
    first = np.take_along_axis(a, fits.argmax(1)[:, None], 1)[:, 0] if len(g) else np.zeros(len(n))
    return np.where(fits.any(1), first, 1 / least)


def bounded(sources: DataFrame, folds: Folds, tokens: np.ndarray, share_l: np.ndarray, share_t: np.ndarray, wanted: float, b: np.ndarray, c: np.ndarray):
    """Chances of at most 1 whose expected sample of ``wanted`` tokens meets the marginals' shares.

    ``sources`` has (source, factor, n, want, cells). A round fits each source's chance
    exactly, then moves languages and topics by a Newton step: the tokens of full cells are
    taken off the target and the rest is raked. Returns the table with each source's
    chance, the factors of languages and topics, and the largest miss as a share of the sample.
    """
    want_l, want_t = reachable(tokens.sum(1), share_l, wanted), reachable(tokens.sum(0), share_t, wanted)
    total, places = tokens.sum(), tokens.size
    by = _source_scale(folds, total, wanted)
    miss = sources.agg(F.max(F.abs(F.least(F.col("n"), F.col("want") / total * by) - F.col("want") / total * wanted))).first()[0]
    lost = max(miss, np.abs(want_l - share_l * wanted).max(), np.abs(want_t - share_t * wanted).max()) / wanted

    def chance(n: np.ndarray, have: np.ndarray, want: np.ndarray, g: np.ndarray) -> np.ndarray:
        return filled(n, g, np.minimum(have, want / total * by))

    off = np.inf
    best = None
    for _ in range(ROUNDS):

        def parted(n: np.ndarray, have: np.ndarray, want: np.ndarray, g: np.ndarray = np.outer(b, c).ravel()) -> np.ndarray:
            """Tokens of the full cells, then of the others times their source's chance."""
            a = chance(n, have, want, g)
            whole = a[:, None] * g >= 1
            return np.concatenate([np.where(whole, n, 0).sum(0), a @ np.where(whole, 0, n)])

        full, rest = folds(parted).reshape(2, *tokens.shape)
        now = full + rest * b[:, None] * c[None, :]
        off = max(np.abs(now.sum(1) - want_l).max(), np.abs(now.sum(0) - want_t).max()) / wanted
        if best is None or off < best[0]:
            best = off, b.copy(), c.copy()
        if off < TOLERANCE:
            break

        def moved(old, want, at_full, at_rest, have):
            newton = (want - at_full) / np.maximum(at_rest, 1e-300)
            plain = old * want / np.maximum(have, 1e-300)
            return np.where((want > at_full) & (at_rest > 1e-12 * wanted / np.maximum(old, 1e-300)), newton, plain)

        b = moved(b, want_l, full.sum(1), rest @ c, now.sum(1))
        now = full + rest * b[:, None] * c[None, :]
        c = moved(c, want_t, full.sum(0), b @ rest, now.sum(0))
    off, b, c = best
    g = np.outer(b, c).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(3), x.column(4), pa.array(chance(*matrix(x, places), g))], names=["source", "factor", "chance"])

    chances = sources.select("n", "want", "cells", "source", "factor").mapInArrow(trimmed(run, folds.slice), "source string, factor double, chance double")
    return materialize(chances), b, c, float(max(off, lost))


def scale_for(n: np.ndarray, w: np.ndarray, wanted: float) -> float:
    """The scale s with sum(min(n, s * w)) = wanted, for tokens n and weighted tokens w of cells."""
    if wanted >= n.sum():
        return float((n / w).max())
    by = np.argsort(n / w)  # the cells in the order in which a growing scale exhausts them
    full, rest = 0.0, w.sum()
    for k in by:
        s = (wanted - full) / rest
        if s <= n[k] / w[k]:
            return float(s)
        full += n[k]
        rest -= w[k]
    return float((n / w).max())


def uniform(id_col: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on a row's id alone, or on its text if it has no id."""
    h = F.when(id_col.isNotNull(), F.xxhash64(id_col.cast("string"), F.lit(seed))).otherwise(F.xxhash64(text, F.lit(seed)))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def cells_of(rows: DataFrame) -> DataFrame:
    """Tokens by source, language and topic; cells without tokens count as one, so that each has a weight."""
    return materialize(rows.groupBy("source", "lang", "topic").agg(F.greatest(F.sum("tokens"), F.lit(1)).alias("n")))


def _chances(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` (with source, lang, topic) and their ``weight`` and ``p``."""
    factors = mix.sources.select("source", F.col("factor").alias("factor_of"), F.col("chance").alias("chance_of"))
    if factors.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        factors = F.broadcast(factors)
    weight = F.col("factor_of") * _lookup(mix.langs, F.col("lang")) * _lookup(mix.topics, F.col("topic"))
    chance = F.col("chance_of") * _lookup(mix.lang_chances, F.col("lang")) * _lookup(mix.topic_chances, F.col("topic"))
    return rows.join(factors, "source", "left").withColumns({"weight": weight, "p": F.least(F.lit(1.0), chance)}).drop("factor_of", "chance_of")


def _whole(tokens: Column) -> Column:
    return F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0))


def _named(name: Column) -> Column:
    return F.coalesce(name.cast("string"), F.lit(""))


def with_cells(docs: DataFrame, text_col: str, topic: Column | None, tokens: Column | None, model: Topics | None) -> DataFrame:
    """All columns of ``docs``, with ``tokens`` (long, at least 0) and ``topic`` (a string)."""
    if topic is not None and tokens is not None:
        return docs.withColumns({"tokens": _whole(tokens), "topic": _named(topic)})
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("tokens", T.LongType()), T.StructField("topic", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(t or b"").split() for t in b.column(place).cast(pa.binary()).to_pylist()]
            topics = [str(model.of(word_vector(w))) if model else "" for w in words]
            cols = [pa.array([len(w) + 1 for w in words], pa.int64()), pa.array(topics, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=schema.names)

    out = docs.mapInArrow(trimmed(run), schema)
    if topic is not None:
        out = out.withColumn("topic", _named(topic))
    if tokens is not None:
        out = out.withColumn("tokens", _whole(tokens))
    return out


def _prepared(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic_col: str | None, tokens_col: str | None, model: Topics | None) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ..., which no name can clash with, and tokens, topic, source, lang."""
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*at.values())
    pick = lambda c: F.col(at[c]) if c else None
    rows = with_cells(rows, at[text_col], pick(topic_col), pick(tokens_col), model)
    return rows.withColumns({"source": _named(pick(source_col)), "lang": _named(pick(lang_col))})


def _cells(docs: DataFrame, about: tuple, more: Callable[[dict[str, Column]], list[Column]] = lambda at: []) -> tuple[DataFrame, Topics | None]:
    """Source, lang, topic, tokens and ``more`` of every row, and the topics if they had to be fitted.

    The fit and the cells share one pass over the texts, whose vectors are written first.
    """
    text_col, source_col, lang_col, topic_col, tokens_col = about
    at = {c: F.col(f"c{k}") for k, c in enumerate(docs.columns)}
    if topic_col:
        return _prepared(docs, *about, None).select("source", "lang", "topic", "tokens", *more(at)), None
    rows = docs.toDF(*(f"c{k}" for k in range(len(at))))
    given = _whole(at[tokens_col]) if tokens_col else F.lit(None).cast("long")
    rows = rows.select(_named(at[source_col]).alias("source"), _named(at[lang_col]).alias("lang"), given.alias("given"), at[text_col].alias("v"), *more(at))
    rows = materialize(measured(rows))
    model = fit_vectors(rows)
    return with_topics(rows, model).withColumn("tokens", F.coalesce("given", "words")).drop("given", "words"), model


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    topic_col: str | None = None, tokens_col: str | None = None, **targets,
) -> DataFrame:
    """One row per row of ``docs``: id, source, lang, topic, n_tokens, weight, probability, kept.

    weight is the raked factor of the row's cell, probability the chance to be kept.
    Without ``topic_col`` topics are fitted, without ``tokens_col`` words are counted. A
    null source, language or topic counts as the empty name, a null text as empty (its
    weight is the end mark's), a null or negative token count as 0. Rows with the same id
    are kept or dropped together. Other columns are ignored; an empty table gives no rows.
    """
    used = [c for c in dict.fromkeys((id_col, text_col, source_col, lang_col, topic_col, tokens_col)) if c]
    rows, _ = _cells(docs.select(*used), (text_col, source_col, lang_col, topic_col, tokens_col), lambda at: [at[id_col].alias("id"), uniform(at[id_col], at[text_col]).alias("u")])
    rows = materialize(rows)
    fitted = rake(cells_of(rows), **targets)
    rows = rows.withColumns({"weight": F.lit(1.0), "p": F.lit(1.0)}) if fitted is None else _chances(rows, fitted)
    return rows.select(
        F.col("id").alias(id_col), "source", "lang", "topic", F.col("tokens").alias("n_tokens"), "weight", F.col("p").alias("probability"), (F.col("u") < F.col("p")).alias("kept"),
    )


def sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    topic_col: str | None = None, tokens_col: str | None = None, **targets,
) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with the columns they had, whatever their names.

    Nulls, repeated rows and empty tables as in ``mix``. The documents aren't shuffled
    unless there are more than ``MOST_BROADCAST`` sources.
    """
    about = (text_col, source_col, lang_col, topic_col, tokens_col)
    cells, model = _cells(docs.select(*(c for c in dict.fromkeys(about) if c)), about)
    fitted = rake(cells_of(cells), **targets)
    if fitted is None:
        return docs
    rows = _chances(_prepared(docs, *about, model), fitted)
    at = {c: F.col(f"c{k}") for k, c in enumerate(docs.columns)}
    return rows.where(uniform(at[id_col], at[text_col]) < F.col("p")).select(*(x.alias(c) for c, x in at.items()))
