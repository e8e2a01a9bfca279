"""Toxicity by weak supervision.

Voters look for a lexicon entry or a pattern each and vote toxic or abstain; one more
votes clean where no lexicon entry occurs. A generative label model estimates, without
labels of the documents it votes on, how accurate each voter is and how strongly voters
repeat each other, and gives every document of the training sample a posterior. A
linear classifier learns these posteriors from words and word beginnings, which spreads
them to documents that no voter sees. Gold labels of training rows serve to propose
lexicon entries, as a weak prior on their accuracies, and to calibrate the scores.

The training sample is bounded (``TRAIN_ROWS`` labelled rows, those with the smallest
hashes of their ids); all documents are scored, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.common import materialize, trimmed

#: Bounds of the model: labelled rows, lexicon voters, features of the classifier.
TRAIN_ROWS, LEXICON, FEATURES = 12_000, 96, 4096
#: A feature must occur in this many training rows.
LEAST = 5
THRESHOLD = 0.7
#: Correlation from which voters are taken to repeat each other.
REPEATS = 0.5
#: Insults that vote even when the labels don't propose them.
SEED_LEXICON = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "bastard", "imbecile")
#: Patterns that vote toxic: shouted words, and insults addressed to a reader.
PATTERNS = (
    re.compile(r"\b[A-Z]{4,}(?:\s+[A-Z]{4,}){2,}!"),
    re.compile(r"\b(?:you|u)(?:'re| are) (?:an? |such an? |so )(?:\w+ )?(?:idiot|moron|loser|clown|fool|pig|stupid|pathetic|worthless)", re.I),
    re.compile(r"\b(?:shut up|get lost|go to hell|drop dead)\b", re.I),
)
_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of word beginnings.
HEADS = (3, 4, 5, 6)


def features(text: str) -> set[str]:
    """What a text shows: words in lower case and their beginnings as ``^abc``.

    ``^abc#`` stands for a beginning that at least two words share, ``^abc%`` for one
    that at least two words and one of a hundred have.
    """
    words = _WORD.findall(text.lower())
    n = len(words)
    own = Counter(words)
    heads: Counter[str] = Counter()
    for w, k in own.items():
        for size in HEADS:
            if len(w) < size:
                break
            heads["^" + w[:size]] += k
    out = set(own) | set(heads)
    for h, k in heads.items():
        if k >= 2:
            out.add(h + "#")
            if 100 * k >= n:
                out.add(h + "%")
    return out


def is_held_out(id_col: str | Column) -> Column:
    """Rows that are never trained on: crc32 of the id as text leaves 1 modulo 3."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Model:
    """A calibrated linear classifier over features."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = {f: w for f, w in weights.items() if f[0] != "^"}
        self.starts = frozenset(f[1:4] for f in weights if f[0] == "^")

    def score(self, text: str) -> float:
        """Equal to the sigmoid of the summed weights of ``features(text)``."""
        words = _WORD.findall(text.lower())
        n = len(words)
        own = Counter(words)
        z = self.bias + sum(self.words[w] for w in self.words.keys() & own.keys())
        heads: Counter[str] = Counter()
        starts = self.starts
        for w in own:
            if w[:3] in starts:
                for size in HEADS:
                    if len(w) < size:
                        break
                    heads["^" + w[:size]] += own[w]
        get = self.weights.get
        for h, k in heads.items():
            z += get(h, 0.0)
            if k >= 2:
                z += get(h + "#", 0.0)
                if 100 * k >= n:
                    z += get(h + "%", 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, clean: np.ndarray, prior: float, gold_fired: np.ndarray, gold_toxic: np.ndarray, rounds: int = 30):
    """Posteriors of rows, accuracies of voters and their correlations.

    ``votes`` (rows, voters) is true where a voter says toxic, ``clean`` where the
    clean voter fires. A voter that abstains says nothing. Expectation-maximisation
    alternates posteriors (log-odds of the votes) and accuracies: where a voter fired,
    the mean posterior that the other voters alone give, with the gold precision as a
    prior of ten votes; so no voter confirms itself. A voter's log-odds
    are divided by one plus twice what its correlations with other voters among likely
    toxic rows have above ``REPEATS``, so that voters that see the same thing count
    about once together; weaker ones come with a text's length and are no repetition.
    """
    n, m = votes.shape
    fired = votes.sum(0)
    base = np.log(prior / (1 - prior))
    precision = (gold_toxic + 1) / (gold_fired + 2)
    acc, acc_clean = np.clip(precision, 0.55, 0.95), 0.95
    x = votes.astype(float)
    discount = np.ones(m)
    corr = np.eye(m)
    q = np.full(n, prior)
    for k in range(rounds):
        lift = (np.log(acc / (1 - acc)) - base) * discount
        z = base + x @ lift + clean * (np.log((1 - acc_clean) / acc_clean) - base)
        new = _sigmoid(z)
        done = np.abs(new - q).max() < 1e-6
        q = new
        others = [_sigmoid(z[votes[:, j]] - lift[j]).sum() for j in range(m)]
        acc = np.clip((others + 10 * precision) / (fired + 10), 0.01, 0.999)
        acc_clean = np.clip((clean @ (1 - q) + 9.5) / (clean.sum() + 10), 0.5, 0.999)
        if k in (0, 3, 9):
            mean = x.T @ q / max(q.sum(), 1e-9)
            dev = x - mean
            cov = (dev * q[:, None]).T @ dev / max(q.sum(), 1e-9)
            sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
            corr = cov / np.outer(sd, sd)
            np.fill_diagonal(corr, 1.0)
            discount = 1 / (1 + 2 * np.clip(corr - np.eye(m) - REPEATS, 0, None).sum(1))
        elif done and k > 10:
            break
    return q, acc, corr


def fit_linear(rows: list[np.ndarray], size: int, q: np.ndarray, l1: float = 1.5e-3, rounds: int = 300) -> tuple[np.ndarray, float, np.ndarray]:
    """Sparse logistic regression on soft labels by accelerated proximal gradient steps."""
    n = len(rows)
    ends = np.cumsum([0, *map(len, rows)])
    cols = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
    at = np.repeat(np.arange(n), np.diff(ends))
    scale = 1 / np.sqrt(np.maximum(np.bincount(cols, minlength=size), 1) / n)
    scale = np.minimum(scale, 8.0)
    w, b = np.zeros(size), float(np.log(np.clip(q.mean(), 1e-3, 0.999) / np.clip(1 - q.mean(), 1e-3, 0.999)))
    margin = lambda w, b: np.bincount(at, weights=(w * scale)[cols], minlength=n) + b
    # The step: the largest eigenvalue of the scaled design, by power iterations.
    v = np.ones(size) / np.sqrt(size)
    top = 1.0
    for _ in range(15):
        v = np.bincount(cols, weights=np.bincount(at, weights=(v * scale)[cols], minlength=n)[at], minlength=size) * scale / n
        top = np.linalg.norm(v)
        v = v / max(top, 1e-12)
    step = 1 / (0.25 * (top + 1) * 1.1)
    yw, yb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(margin(yw, yb), -30, 30))) - q
        g = np.bincount(cols, weights=r[at], minlength=size) * scale / n
        nw = yw - step * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nb = yb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        yw, yb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w * scale, b, margin(w, b)


def platt(z: np.ndarray, gold: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the sigmoid that maps margins to the chance of a gold label."""
    pos, neg = gold.sum(), len(gold) - gold.sum()
    t = np.where(gold, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[w @ (z * z) + 1e-6, w @ z], [w @ z, w.sum() + 1e-6]])
        d = np.linalg.solve(h, [(p - t) @ z, (p - t).sum()])
        norm = np.linalg.norm(d)
        a, b = (a, b) - d * min(1.0, 2.0 / max(norm, 1e-12))
        if norm < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def _fallback() -> Model:
    """Without labels of both classes: the seed lexicon alone."""
    return Model(dict.fromkeys(SEED_LEXICON, 3.0), -2.0)


def propose(tallied: list[tuple[str, int, int]]) -> list[str]:
    """Lexicon entries from (feature, toxic rows, clean rows), the best first.

    An entry's rows are toxic in four of five cases, at least. Of features that begin
    alike and occur equally often only the first is taken: they see the same rows.
    """
    out, met = [], set()
    for f, toxic, clean in tallied:
        key = (f.lstrip("^")[:3], toxic, clean)
        if toxic >= LEAST and toxic >= 4 * clean and key not in met:
            met.add(key)
            out.append(f)
    return out[:LEXICON] + [w for w in SEED_LEXICON if w not in out]


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(id, toxic, text) of at most ``rows`` labelled rows outside the held-out third."""
    gold = (
        labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out("id"))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    pick = gold.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(7)), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # At most ``rows`` ids and labels, so the broadcast has a bound.
    return materialize(texts.join(F.broadcast(pick), "id").select("id", "toxic", "text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Lexicon, label model, classifier and calibration, from training rows only."""
    sample = training_sample(docs, labels, id_col, text_col, rows)
    n, toxic = sample.agg(F.count("*"), F.sum("toxic")).first()
    toxic = toxic or 0
    if min(toxic, n - toxic) < LEAST:
        return _fallback()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flush():
            words = list(counts[0].keys() | counts[1].keys())
            cols = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)]
            return pa.RecordBatch.from_arrays(cols, names=["feature", "clean", "toxic"])

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[bool(y)].update(features(t))
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield flush()
                counts = (Counter(), Counter())
        yield flush()

    t, c = F.col("toxic") / toxic, F.col("clean") / (n - toxic)
    seen = (F.col("toxic") + F.col("clean")) / n
    z = (t - c) / F.sqrt(seen * (1 - seen) * (1 / toxic + 1 / (n - toxic)) + 1e-12)
    tallied = (
        sample.select("toxic", "text").mapInArrow(trimmed(tally), "feature string, clean long, toxic long")
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") + F.col("clean") >= LEAST)
        .orderBy(F.abs(z).desc(), "feature").limit(FEATURES).collect()
    )
    names = [r.feature for r in tallied]
    number = {f: k for k, f in enumerate(names)}
    lexicon = propose([(r.feature, r.toxic, r.clean) for r in tallied])
    if not number:
        return _fallback()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes, ids = [], []
            for x in b.column(2).to_pylist():
                own = features(x)
                fired = [w in own for w in lexicon] + [bool(p.search(x)) for p in PATTERNS]
                votes.append(np.packbits(fired).tobytes())
                ids.append(np.array(sorted(number[f] for f in own if f in number), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(votes, pa.binary()), pa.array(ids, pa.binary())], names=["id", "toxic", "votes", "ids"])

    schema = T.StructType([sample.schema["id"], T.StructField("toxic", T.IntegerType()), T.StructField("votes", T.BinaryType()), T.StructField("ids", T.BinaryType())])
    got = sorted(sample.select("id", "toxic", "text").mapInArrow(trimmed(look), schema).collect(), key=lambda r: (str(r.id), bytes(r.ids)))
    gold = np.array([r.toxic > 0 for r in got])
    m = len(lexicon) + len(PATTERNS)
    votes = np.array([np.unpackbits(np.frombuffer(r.votes, np.uint8), count=m) for r in got]).astype(bool)
    clean = ~votes[:, : len(lexicon)].any(1)
    fires = votes.sum(0) >= 3
    q, _, _ = label_model(votes[:, fires], clean.astype(float), float(np.clip(gold.mean(), 0.01, 0.5)), votes[:, fires].sum(0), votes[gold][:, fires].sum(0))
    w, bias, z = fit_linear([np.frombuffer(r.ids, "<i4") for r in got], len(names), q)
    slope, shift = platt(z, gold)
    return Model({f: float(slope * x) for f, x in zip(names, w, strict=True) if x}, float(slope * bias + shift))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    A null text counts as empty and gets the score of no words. A null id counts as
    the empty text for held_out. Repeated rows keep their rows; other columns are
    ignored; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).alias(id_col), is_held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(x) for x in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "held_out", "score", "predicted"])

    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return src.mapInArrow(trimmed(run), T.StructType(fields))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Trains on the labelled rows and scores all of ``docs``; edge cases as in ``score``."""
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col, threshold)


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with the columns they had, whatever their names.

    A null text is scored as an empty one. Rows with null ids and repeated rows are judged
    like any other; an empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(x or "") < threshold for x in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
