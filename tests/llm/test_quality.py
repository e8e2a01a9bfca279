import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabularium.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 5]) for k in range(n - 4))
    covered = {k + j for k in range(n - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_measures_equal_brute_force(request, which):
    df = request.getfixturevalue(which)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted(((r.doc_id, *(r[c] for c in names), r.base_failed) for r in quality.measure(df).collect()), key=str)
    want = []
    for r in df.select("doc_id", "text").collect():
        b = brute(r.text)
        want.append((r.doc_id, *b, b[0] < 10 or 100 * b[4] > 20 * b[0]))
    assert got == sorted(want, key=str)


def test_order_never_changes_a_verdict(docs):
    rules = list(quality.BASE + quality.EXTRA)
    text = F.coalesce(F.col("text"), F.lit(""))
    verdict = lambda order: {r.doc_id for r in docs.where(quality.let(quality.words_of(text), lambda w: quality.first_rejection(text, w, order)).isNull()).collect()}
    assert verdict(rules) == verdict(rules[::-1]) == {r.doc_id for r in quality.keep_good(docs).collect()}


def test_clean_rows_stay_and_bad_rows_go(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.measure(docs).join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    assert all(not r.kept for r in rows if r.quality == 0)


def test_estimates_rank_by_rejection_per_cost(docs):
    ranked = quality.estimate(docs, quality.BASE + quality.EXTRA)
    assert [x.rank for x in ranked] == sorted((x.rank for x in ranked), reverse=True)
    assert all(0 <= x.rejected <= 1 and x.seconds_per_row > 0 for x in ranked)


def test_no_python_on_the_main_path(docs):
    plan = quality.measure(docs)._jdf.queryExecution().executedPlan().toString() + quality.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_and_odd(no_docs, odd_docs):
    assert quality.measure(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 5, None, 12}
