import math
import re

import numpy as np
import pytest

from tabularium.llm import url_filter as U

URLS = [
    "https://www.Example.ORG/es/1?x", "http://example.org/en/12#a", "http://example.org/en/2", "https://a.example.com/fr/5.html", "https://a.example.com/de/5", "http://b.com/en/3",
    "http://x.net/fr/1", None, "", "no scheme/fr/", "http://org", "http://org/", "HTTP://A.B.COM?x=/fr/", "ftp://user@h.org:80/p?q://z", "http://notorg/", "http://.org/", "://org/x", "http://Ä.org/ü/é", "http://example.orgx/es/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    best = None
    for verdict, rule in U.RULES:
        at, _, tail = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def frame(spark, urls):
    return spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, score string")


def test_rules_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()
    urls = URLS + [r.url for r in pages] + URLS
    for r in U.judge(frame(spark, urls)).collect():
        host, path, best = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
        assert (r.score is None) == (best is not None)
        if not host and not path:
            assert r.verdict == "block"


def brute_log2p(train, text, order, discount, floor=0):
    """Interpolated absolute discounting by dictionaries."""
    counts = {}
    for t in train:
        s = "\x02" * order + t
        for k in range(order, len(s)):
            for n in range(order + 1):
                counts.setdefault(s[k - n : k], {}).setdefault(s[k], 0)
                counts[s[k - n : k]][s[k]] += 1
    counts = {c: {x: n for x, n in m.items() if n >= floor} for c, m in counts.items()}
    out = []
    s = "\x02" * order + text
    for k in range(order, len(s)):
        p = 1 / 256
        for n in range(order + 1):
            m = counts.get(s[k - n : k])
            if m:
                p = (max(m.get(s[k], 0) - discount, 0) + discount * len(m) * p) / sum(m.values())
        out.append(math.log2(p))
    return out


def test_model_equals_brute_force(spark):
    good, bad = ["abcabc/x", "abd/xy", "abc"], ["zzz/1", "zyz/2", "zab"]
    df = spark.createDataFrame([(True, t) for t in good] + [(False, t) for t in bad], "good boolean, text string")
    rows = U.count_ngrams(df, 3).collect()
    parts = [np.array([(r.key, r.n) for r in rows if r.good == g], np.int64).T for g in (True, False)]
    model = U.Ratio(U.Markov.of(*parts[0]), U.Markov.of(*parts[1]), 3, 0.6)
    texts = ["abc/", "zab/1", "q", "", "abcabc"]
    want = [sum(a - b for a, b in zip(brute_log2p(good, t, 3, 0.6), brute_log2p(bad, t, 3, 0.6), strict=True)) / max(1, len(t)) for t in texts]
    assert model.scores([t.encode() for t in texts]) == pytest.approx(want)
    assert want[0] > 0 > want[1]


def test_pruned_counts_back_off(spark):
    df = spark.createDataFrame([("ab%02d/x" % (k % 10), "allow" if k % 2 else "block") for k in range(400)], "text string, ruled string")
    small = U.train(df, order=3, max_ngrams=60)
    assert len(small.good.keys) + len(small.bad.keys) <= 60
    assert np.isfinite(small.scores([b"ab00/x", b"unseen", "é".encode()])).all()


def test_judge_keeps_all_counts(spark):
    """More n-grams than the earlier bound of 400,000: scores are those of the whole models."""
    rng = np.random.default_rng(6)
    path = lambda: "".join(map(chr, rng.integers(97, 123, 30)))
    urls = [f"http://a{k % 7}.org/{path()}" for k in range(3500)] + [f"http://a{k % 7}.com/de/{path()}" for k in range(2500)] + [f"http://b.net/{path()}" for _ in range(20)] + ["http://q.net/é", "x"]
    rows = U.judge(frame(spark, urls)).collect()
    texts = {(r.host + r.path): r.score for r in rows if r.rule is None}
    from pyspark.sql import functions as F

    ruled = spark.createDataFrame([(r.verdict == "allow", r.host + r.path) for r in rows if r.rule], "good boolean, text string")
    got = U.count_ngrams(ruled.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(U.FOLD)) != 0)).collect()
    assert len(got) > 400_000
    parts = [np.array([(r.key, r.n) for r in got if r.good == g], np.int64).T for g in (True, False)]
    whole = U.Ratio(U.Markov.of(*parts[0]), U.Markov.of(*parts[1]))
    assert list(texts.values()) == pytest.approx(whole.scores([t.encode() for t in texts]).tolist())


def test_threshold():
    assert U.best_threshold([(0, False, 5), (10, True, 5)]) == pytest.approx(10 * U.BIN)
    assert U.best_threshold([(3, True, 5)]) == -np.inf and U.best_threshold([(3, False, 5)]) == np.inf and U.best_threshold([]) == 0.0


def test_tables_without_one_class(spark):
    assert U.judge(frame(spark, URLS).limit(0)).count() == 0
    got = {r.page_id: r.verdict for r in U.judge(frame(spark, ["http://a.net/x", "http://b.net/y"])).collect()}
    assert got == {0: "allow", 1: "allow"}
    rows = U.judge(frame(spark, [f"http://h{k}.org/p" for k in range(50)] + ["http://q.net/p"])).collect()
    assert rows[-1].verdict == "allow"
