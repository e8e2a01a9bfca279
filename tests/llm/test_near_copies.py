"""Near copies by several tries against the Jaccard similarities of all pairs."""

import numpy as np

from tabularium.llm import simhash

from .test_simhash import LOWER


def brute_keep(rows, width=5, similarity=0.8):
    """The smallest ids of the groups that exact shingle sets of all pairs connect."""
    sets, same = [], {}
    for _, text in rows:
        w = (text or "").translate(LOWER).encode().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        root[max(find(a), find(b))] = min(find(a), find(b))

    heads = []
    for a, s in enumerate(sets):
        key = frozenset(s)
        if key in same:
            join(a, same[key])
        else:
            same[key] = a
            heads.append(a)
    for k, a in enumerate(heads):
        for b in heads[:k]:
            if 5 * min(len(sets[a]), len(sets[b])) < 4 * max(len(sets[a]), len(sets[b])):
                continue
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                join(a, b)
    return sorted({min(rows[k][0] for k in range(len(rows)) if find(k) == g) for g in set(map(find, range(len(rows))))})


def near_rows(seed=3):
    """A large group of near copies, chains of edits, and texts that share a common passage."""
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    common, rows = words(40), []
    for size in (60, 6, 6, 6):
        text = words(80)
        for _ in range(size):
            if size == 6:
                text = list(text)
            new = list(text)
            for k in rng.integers(0, 80, rng.integers(0, 4)):
                new[k] = f"x{rng.integers(0, 5000)}"
            rows.append(" ".join(new).upper() if rng.random() < 0.3 else " ".join(new))
            if size == 6:
                text = new
    rows += [" ".join(words(60) + common) for _ in range(40)]
    rows += ["a b", "A  b", "a b c", "", " \n", None, "z z z z z z", "z z z z z z z z"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]


def test_equals_jaccard_of_all_pairs(spark):
    """With a budget that all such pairs keep, nothing is missed."""
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.keep_similar(df, sketches=2, budget=11)
    want = brute_keep(rows)
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < len(rows) - 40


def test_hot_nodes_are_cut_without_loss(spark):
    df = spark.createDataFrame(near_rows(), "doc_id long, text string")
    got, want = (simhash.keep_similar(df, sketches=2, budget=2, split_rows=n) for n in (4, 50_000))
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())


def test_production_parameters_find_nine_of_ten(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = set(brute_keep(rows))
    got = {r.doc_id for r in simhash.keep_similar(docs).collect()}
    assert want <= got  # what goes is similar
    assert len(rows) - len(got) >= 0.9 * (len(rows) - len(want)) and len(want) < len(rows)


def test_odd_and_empty(docs, no_docs, odd_docs):
    assert simhash.keep_similar(docs).columns == docs.columns
    assert simhash.keep_similar(no_docs).count() == 0
    kept = simhash.keep_similar(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 7, 8, 9, 10, 11, 12, 13, 14]


def test_sketches_equal_plain_counts():
    import xxhash

    text = b"the quick brown fox jumps over THE lazy dog"
    _, got = simhash.word_sketches(text, 3)
    own = set(text.lower().split())
    mask = (1 << 64) - 1
    for k in range(3):
        counts = [0] * 64
        for w in own:
            x = (xxhash.xxh64_intdigest(w, 42) + (k + 1) * 0x9E3779B97F4A7C15) & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            x ^= x >> 31
            for b in range(64):
                counts[b] += x >> b & 1
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * counts[b] > len(own))
