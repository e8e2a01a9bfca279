import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabularium.llm import simhash
from tabularium.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints, budget=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(prints))]


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_equals_brute_force(request, which):
    df = request.getfixturevalue(which).select("doc_id", F.substring("text", 1, 3000).alias("text"))
    src = df.collect()
    prints = [brute_print(r.text) for r in src]
    roots = brute_components(prints)
    groups = {}
    for r, g in zip(src, roots, strict=True):
        groups.setdefault(g, []).append(r.doc_id)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    want = sorted(((r.doc_id, f"{p:016x}", least[g]) for r, p, g in zip(src, prints, roots, strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str) == want


def near_prints(seed=5, centres=40, each=60):
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(centres):
        c = int(rng.integers(0, 1 << 63)) << 1
        for _ in range(each):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("split_rows", "chunk_rows"), [(50_000, 200_000), (5, 16)])
def test_no_link_is_lost(spark, split_rows, chunk_rows):
    """Also when every block is hot and is dealt as pairs of nodes."""
    prints = near_prints()
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(spark.createDataFrame([(0, x) for x in signed], "family int, fp long"), 2, split_rows, chunk_rows)
    at = {x: k for k, x in enumerate(signed)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges.collect():
        a, b = find(at[r.u]), find(at[r.v])
        root[max(a, b)] = min(a, b)
    assert [find(x) for x in range(len(prints))] == brute_components(prints)


def test_trie_links_of_all_pairs_near():
    keys = np.array(sorted({1 << a | 1 << b for a in range(64) for b in range(64)}), np.uint64)
    n = len(keys)
    found = list(simhash.trie_links(keys, [0], [n], [0], [n], [0], 0, 2))
    (i, j), = simhash._as_stars(iter(found))
    assert len(i) == n - 1 and set(j) == {0}
    every = [(a, b) for x, y in found for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert sorted(every) == [(a, b) for a in range(n) for b in range(a + 1, n) if int(keys[a] ^ keys[b]).bit_count() <= 2]


@pytest.mark.parametrize("split_rows", [50_000, 5])
def test_each_link_is_met_once(spark, split_rows):
    """In two families, with fingerprints that repeat, also when hot nodes are cut again and again."""
    prints = near_prints(centres=10)
    rows = [(f, x - (1 << 64) if x >> 63 else x, k) for f in (0, 1) for k, x in enumerate(prints[f * 100 :] + prints[-3:])]
    df = spark.createDataFrame(rows, "family int, fp long, id long")
    as_ids = lambda: lambda found, carried: ((carried[0][i], carried[0][j]) for i, j in found)
    got = sorted((r.family, *sorted((r.u, r.v))) for r in simhash.links(df, 3, split_rows, 64, ("id",), as_ids).collect())
    want = [(f, *sorted((a, b))) for k, (f, x, a) in enumerate(rows) for g, y, b in rows[:k] if f == g and ((x ^ y) & (1 << 64) - 1).bit_count() <= 3]
    assert got == sorted(want) and len(want) > 100


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, 2000 + k) for k in range(300)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[2000 + k] == 1000 for k in range(300))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_of_each_component(odd_docs, docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 7, 8, 9, 10, 11, 12, 13, 14], key=str)
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
