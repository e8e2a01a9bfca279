import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabularium.llm import licenses as L
from tabularium.llm import mixing as M

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_rake(cells, power=M.POWER):
    names = [sorted({c[k] for c in cells}) for k in range(3)]
    x = np.zeros([len(n) for n in names])
    for s, l, t, n in cells:
        x[names[0].index(s), names[1].index(l), names[2].index(t)] += n
    share = lambda v: v**power / (v**power).sum() * x.sum()
    want = [share(x.sum((1, 2))), share(x.sum((0, 2))), share(x.sum((0, 1)))]
    g = np.ones_like(x)
    for _ in range(3000):
        g *= (want[0] / (x * g).sum((1, 2)))[:, None, None]
        g *= (want[1] / (x * g).sum((0, 2)))[None, :, None]
        g *= (want[2] / (x * g).sum((0, 1)))[None, None, :]
    return {(s, l, t): g[names[0].index(s), names[1].index(l), names[2].index(t)] for s, l, t, _ in cells}


def test_raking_and_sampling_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.mix(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    weights = M.fit_topics(docs).weights
    cells = {}
    for r in rows:
        words = text[r.doc_id].encode().split()
        v = np.zeros(M.DIMENSIONS)
        for w in {w for w in words if len(w) > 3}:
            v[zlib.crc32(w) % M.DIMENSIONS] += math.log1p(words.count(w))
        n = len(words) + 1
        assert (r.n_tokens, r.topic) == (n, str((weights @ v).round(9).argmax()))
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + n
    g = brute_rake([(*k, n) for k, n in cells.items()])
    assert max(abs(r.weight / g[r.source, r.lang, r.topic] - 1) for r in rows) < 1e-6
    total = sum(r.n_tokens for r in rows)
    assert sum(r.probability * r.n_tokens for r in rows) / total == pytest.approx(M.SHARE, abs=0.002)
    kept = M.sample(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_expected_sample_meets_every_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.mix(docs).collect()
    for key in ("source", "lang", "topic"):
        names = sorted({r[key] for r in rows})
        have = np.array([sum(r.n_tokens for r in rows if r[key] == x) for x in names], float)
        got = np.array([sum(r.n_tokens * r.probability for r in rows if r[key] == x) for x in names])
        # The target shares; names that have less than that come whole and the others share the rest.
        want = M.reachable(have, M.target_shares(have, names, M.POWER, None), M.SHARE * have.sum())
        assert np.abs(got - want).max() / got.sum() < 0.002


def test_topics_part_what_differs(spark):
    rng = np.random.default_rng(1)
    kinds = [[f"{name}{k}" for k in range(60)] for name in ("cook", "ship", "note")]
    rows = [(i, " ".join(rng.choice(kinds[i % 3], 40)), "s", "en") for i in range(150)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    groups = [{r.topic for r in got if r.doc_id % 3 == k} for k in range(3)]
    assert not any(groups[a] & groups[b] for a in range(3) for b in range(a))


def test_topics_are_fitted_on_all_texts(spark):
    """Brute force over 9,000 texts: document frequencies, unit centroids, each the mean of its members; copies and dealing change nothing."""
    rng = np.random.default_rng(6)
    kinds = [[f"{name}{k}" for k in range(30)] for name in ("cook", "ship", "note")]
    texts = sorted({" ".join(rng.choice(kinds[i % 3], 12)) for i in range(9000)})
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:1] * 500]], "text string").repartition(3).cache()
    weights = M.fit_topics(docs, topics=3).weights
    assert np.array_equal(weights, M.fit_topics(docs.repartition(5), topics=3).weights)
    x = np.zeros((len(texts), M.DIMENSIONS))
    for row, t in zip(x, texts, strict=True):
        words = t.encode().split()
        for w in set(words):
            row[zlib.crc32(w) % M.DIMENSIONS] += math.log1p(words.count(w))
    idf = np.log((1 + len(texts)) / (1 + (x > 0).sum(0))) + 1
    centres = weights / idf
    assert np.abs(np.linalg.norm(centres, axis=1) - 1).max() < 1e-9
    x *= idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = (x @ centres.T).argmax(1)
    sums = np.stack([x[own == k].sum(0) for k in range(3)])
    assert np.abs(sums / np.linalg.norm(sums, axis=1, keepdims=True) - centres).max() < 1e-5
    docs.unpersist()


def test_given_topics_and_tokens(spark):
    df = spark.createDataFrame([(i, "x", "s", "en", ["a", "b", None][i % 3], [10, 20, None, -5][i % 4]) for i in range(120)], "doc_id long, text string, source string, lang string, about string, n int")
    rows = M.mix(df, topic_col="about", tokens_col="n", topic_shares={"a": 0.5}, share=0.3).collect()
    assert {(r.doc_id, r.topic, r.n_tokens) for r in rows} == {(i, ["a", "b", ""][i % 3], [10, 20, 0, 0][i % 4]) for i in range(120)}
    total = sum(r.probability * r.n_tokens for r in rows)
    assert sum(r.probability * r.n_tokens for r in rows if r.topic == "a") / total == pytest.approx(0.5, abs=0.002)
    kept = M.sample(df, topic_col="about", tokens_col="n", topic_shares={"a": 0.5}, share=0.3)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_given_targets_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.mix(docs, share=0.2, lang_shares={"en": 0.25, "fr": 0.4}, source_shares={"src1": 0.1}).collect()
    weighted = lambda f: sum(r.weight * r.n_tokens for r in rows if f(r)) / sum(r.weight * r.n_tokens for r in rows)
    assert weighted(lambda r: r.lang == "en") == pytest.approx(0.25, abs=1e-6)
    assert weighted(lambda r: r.lang == "fr") == pytest.approx(0.4, abs=1e-6)
    assert weighted(lambda r: r.source == "src1") == pytest.approx(0.1, abs=1e-6)


def test_mixing_odd_and_empty(odd_docs, no_docs):
    rows = M.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 < r.probability <= 1 for r in rows)
    assert len({r.kept for r in rows if r.doc_id == 5}) == 1
    assert M.mix(no_docs).count() == 0 and M.sample(no_docs).count() == 0
    assert M.sample(odd_docs).columns == odd_docs.columns


def test_scale():
    n, w = np.array([10.0, 10.0, 10.0]), np.array([1.0, 5.0, 20.0])
    for wanted in (1.0, 12.0, 20.0, 29.9):
        s = M.scale_for(n, w, wanted)
        assert np.minimum(n, s * w).sum() == pytest.approx(wanted)
    assert np.minimum(n, M.scale_for(n, w, 40.0) * w).sum() == pytest.approx(30.0)


def test_sample_meets_targets_where_chances_are_bounded(spark):
    """A hot source of a third of the tokens: cells at chance 1 are made up for by others."""
    rng = np.random.default_rng(4)
    cells = [(f"s{s}", lang, t, int(rng.integers(20, 60) * w * (40 if s == 0 else 1))) for s in range(20) for lang, w in (("en", 12), ("fr", 2), ("es", 1)) for t in "0123"]
    fitted = M.rake(spark.createDataFrame(cells, "source string, lang string, topic string, n long"))
    row = {r.source: r for r in fitted.sources.collect()}
    p = [min(1.0, row[s].chance * fitted.lang_chances[g] * fitted.topic_chances[t]) for s, g, t, _ in cells]
    n = np.array([float(x[3]) for x in cells])
    assert sum(x == 1.0 for x in p) > 5 and (n * p).sum() == pytest.approx(M.SHARE * n.sum(), rel=1e-6)
    for k in range(3):
        names = sorted({x[k] for x in cells})
        have = np.array([sum(x[3] for x in cells if x[k] == name) for name in names], float)
        got = np.array([sum(a * b for a, b, x in zip(n, p, cells, strict=True) if x[k] == name) for name in names])
        want = M.reachable(have, M.target_shares(have, names, M.POWER, None), M.SHARE * n.sum())
        assert got == pytest.approx(want, rel=1e-5)


def test_rounds_on_the_driver_and_in_tasks_agree(spark, monkeypatch):
    """Raking and bounded raking start few jobs where sources are few; where they are many, tasks give the same weights and chances."""
    rng = np.random.default_rng(4)
    cells = [(f"s{s}", lang, t, int(rng.integers(20, 60) * w * (40 if s == 0 else 1))) for s in range(20) for lang, w in (("en", 12), ("fr", 2), ("es", 1)) for t in "0123" if (s, lang, t) != (3, "fr", "1")]
    table = spark.createDataFrame(cells, "source string, lang string, topic string, n long")
    got = []
    for most in (M.MOST_LOCAL, 0):
        monkeypatch.setattr(M, "MOST_LOCAL", most)
        spark.sparkContext.setJobGroup(f"rake{most}", "")
        fitted = M.rake(table)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rake{most}"))
        assert not most or jobs < 40
        row = {r.source: r for r in fitted.sources.collect()}
        got.append([x for s, g, t, _ in cells for x in (row[s].factor * fitted.langs[g] * fitted.topics[t], min(1.0, row[s].chance * fitted.lang_chances[g] * fitted.topic_chances[t]))])
    spark.sparkContext._jsc.clearJobGroup()
    assert got[0] == pytest.approx(got[1], rel=1e-6) and sum(x == 1.0 for x in got[0]) > 5


def test_filled_rows_take_what_is_wanted():
    n = np.array([[10.0, 0.0, 5.0, 20.0], [1.0, 1.0, 1.0, 1.0], [0.0, 0.0, 7.0, 0.0], [3.0, 4.0, 0.0, 0.0]])
    g = np.array([0.5, 2.0, 0.1, 4.0])
    for part in (0.0, 0.2, 0.7, 0.999, 1.0):
        a = M.filled(n, g, part * n.sum(1))
        assert (n * np.minimum(1, a[:, None] * g)).sum(1) == pytest.approx(part * n.sum(1))
    assert M.filled(n, np.zeros(4), n.sum(1)).tolist() == [0.0] * 4


def test_unit_vectors_in_whole_parts():
    """Also of a slice; what is written is the unit vector up to half a part, and products don't depend on their slices."""
    rng = np.random.default_rng(2)
    words = [[f"word{k}".encode() for k in rng.integers(0, 900, n)] for n in (1, 40, 700, 3, 200)]
    vectors = pa.array([M.word_vector(w).tobytes() for w in words], pa.binary())
    idf = 1 + rng.random(M.DIMENSIONS)
    x = M.dense(*M.flat(vectors, M.ENTRY)) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.array_equal(M.dense(*M.flat(M.unit_parts(vectors, idf), M.PART)), np.rint(x * M.WHOLE))
    assert M.unit_parts(vectors.slice(2, 2), idf) == M.unit_parts(vectors, idf).slice(2, 2)
    many = rng.random((2 * M.PRODUCT_ROWS + 5, M.DIMENSIONS))
    assert np.allclose(M.nearness(many, x), many @ x.T, atol=1e-12) and M.nearness(many[:0], x).shape == (0, 5)


def test_unreachable_targets_are_reported(spark):
    cells = spark.createDataFrame([("a", "en", "0", 900), ("a", "fr", "0", 100)], "source string, lang string, topic string, n long")
    with pytest.warns(UserWarning, match="misses targets"):
        fitted = M.rake(cells, lang_shares={"fr": 0.5, "en": 0.5})
    assert fitted.sample_error == pytest.approx(0.5 - 100 / 700)


def brute_base(text):
    words = WORD.findall((text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def brute_labels(text, threshold=L.THRESHOLD):
    text = (text or "").translate(LOWER)
    found = dict.fromkeys(filter(None, brute_base(text)[4].split(",")), 1.0)
    lines = [WORD.findall(x) for x in text.split("\n")]
    groups, run = [], []
    for x in [*lines, []]:
        if x:
            run.append(x)
            groups.append(x)
        else:
            if len(run) > 1:
                groups.append(sum(run, []))
            run = []
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    cut = [g[k : k + 120] for g in groups for k in (range(0, len(g) - 60, 60) if len(g) > 120 else [0])]
    for label, template, naming in L.TEMPLATES:
        t, named = pairs(template.split()), pairs(naming.split())
        for b in map(pairs, cut):
            n = len(t & b)
            if named <= b and n >= math.ceil(threshold * len(t) - 1e-9):
                found[label] = max(found.get(label, 0), n / len(t))
    return ",".join(sorted(found)), max(found.values(), default=0.0)


NOTES = [
    "x\nReleased under the MIT license, see below.\n\nA b c", "This work is licensed under the\nGNU General Public License,\nversion 3.", "licensed under CC-BY-NC (4.0)", "All rights\n\nreserved", "all rights reserved",
    "under the mit license under the MIT License", "cc by nc cc by nc", "apache license version 2apache license version 2", "Permission is hereby granted free of charge to any person obtaining a copy of this software", "É under the mit licenseé",
]


@pytest.mark.parametrize("which", ["docs", "odd_docs", "notes"])
def test_licenses_equal_brute_force(request, spark, which):
    df = spark.createDataFrame(list(enumerate(NOTES)), "doc_id long, text string") if which == "notes" else request.getfixturevalue(which)
    got = sorted((tuple(r) for r in L.license_labels(df).collect()), key=str)
    want = sorted(((r.doc_id, *brute_base(r.text), *brute_labels(r.text)) for r in df.select("doc_id", "text").collect()), key=str)
    assert got == want


def test_filters_lose_no_match():
    """Random blocks around templates, under several global orders and thresholds."""
    rng = np.random.default_rng(8)
    vocabulary = sorted(L.vocabulary())
    for threshold in (0.5, 0.8, 1.0):
        freq = {w: int(rng.integers(0, 50)) for w in vocabulary}
        ix = L.build_index(freq, L.TEMPLATES, threshold)
        for _ in range(300):
            base = L.TEMPLATES[rng.integers(len(L.TEMPLATES))][1].encode().split()
            extra = [w for k in rng.integers(0, len(vocabulary), rng.integers(0, 9)) for w in vocabulary[k]]
            block = [w for w in base if rng.random() < 0.95] + extra + [b"other"]
            pairs, want = set(zip(block, block[1:], strict=False)), {}
            for k, (_, t, naming) in enumerate(L.TEMPLATES):
                s, named = L._of(t), L._of(naming)
                n = len(s & pairs)
                if named <= pairs and n >= math.ceil(threshold * len(s) - 1e-9):
                    want[k] = n / len(s)
            assert L.matches(block, ix) == want


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the BSD license.", "bsd"),
        ("Licensed under the Mozilla Public License Version 2.0", "mpl-2"),
        ("Licensed under CC BY 4.0", "cc-by"),
        ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        ("all other rights were reserved", ""),
        ("under the GNU Affero General Public License you can redistribute it and/or modify it. This program is free software", ""),
        ("the license was released by mit under protest of the apache version 2 license of 0", ""),
        ("Released under the MIT License", "mit"),
        ("Licensed under the Apache License, Version 2.0", "apache-2"),
        ("x " * 300 + "All rights reserved", "all-rights-reserved"),
    ],
)
def test_the_license_that_is_named(text, labels):
    ix = L.build_index({})
    found = {ix.labels[k] for _, words in L.blocks(text.encode().translate(L.WORDS)) for k in L.matches(words, ix)}
    assert ",".join(sorted(found)) == labels


def test_license_blocks_and_empty(spark, no_docs, odd_docs):
    df = spark.createDataFrame([(1, NOTES[1])], "doc_id long, text string")
    rows = L.license_blocks(df).collect()
    assert [(r.label, r.first_word, r.n_words, r.containment) for r in rows] == [("gpl-3", 0, 12, 1.0)]
    assert L.license_labels(no_docs).count() == 0 and L.license_blocks(no_docs).count() == 0
    assert L.license_blocks(odd_docs).count() >= 1
