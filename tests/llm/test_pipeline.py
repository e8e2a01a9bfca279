"""The pipeline against plain Python over the smallest tables, stage by stage."""

import hashlib
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as P
from tabularium.llm import mixing, toxicity
from tabularium.llm.common import materialize

from .test_near_copies import brute_keep
from .test_quality import WORD, brute
from .test_tokens import library

SF = "/root/testdata/sf0.001"


def rejected(text):
    n, chars, symbols, dups, repeats = brute(text)
    words = WORD.findall(text)
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    shouts = len(text) - len(text.replace("!!", "!"))
    return (
        n < 10 or 100 * repeats > 20 * n or 10 * symbols > n or 10 * shouts > n or chars > 20 * n or chars < 2 * n
        or 10 * stutter > 3 * n or 2 * dups > len(text.split("\n"))
    )


def chance(doc_id):
    h = xxhash.xxh64_intdigest(str(doc_id).encode(), 42)
    return (xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), h) >> 11) / (1 << 53)


def test_each_stage_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in docs.collect()}
    civil = {i for i, r in rows.items() if sum(model.weights.get(f, 0.0) for f in toxicity.features(r.text)) + model.bias < np.log(0.7 / 0.3)}
    good = {i for i in civil if not rejected(rows[i].text)}
    order = sorted(good)
    first = set(brute_keep([(i, rows[i].text) for i in order]))
    # That mix() meets its targets, and its cells, are compared with plain Python in test_mixing_licenses.
    p = {r.doc_id: r.probability for r in mixing.mix(docs.where(F.col("doc_id").isin(sorted(first)))).collect()}
    mixed = {i for i in first if chance(i) < p[i]}
    tok = library()
    final = set()
    for i in mixed:
        ids = tok.encode(rows[i].text, add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        final.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))

    at = docs
    for (_, stage), want in zip(P.STAGES, (civil, good, first, mixed), strict=False):
        at = materialize(stage(spark, at, SF))
        assert at.columns == docs.columns
        assert sorted(r.doc_id for r in at.select("doc_id").collect()) == sorted(want)
    out = P.run(spark, SF)
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()} == final
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
    assert len(civil) < len(rows) and len(good) < len(civil) and len(first) < len(good) and len(mixed) < len(first)


def test_odd_documents(spark, odd_docs, tmp_path):
    """Nulls, repeated rows and columns of clashing names come through all stages but the last."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = odd_docs
    for _, stage in P.STAGES[:-1]:
        at = materialize(stage(spark, at, str(tmp_path)))
        assert at.columns == odd_docs.columns
    assert {1, 7} >= {r.doc_id for r in at.collect()} - {8, 12, 13, 14}
    assert materialize(P.STAGES[-1][1](spark, odd_docs, str(tmp_path))).count() == odd_docs.count()


def test_empty_documents(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        at = materialize(stage(spark, at, SF))
    assert at.count() == 0


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality rules", "SimHash near-dedup", "mixing", "BPE"]


def test_mixing_fits_topics_on_every_text(spark, monkeypatch):
    """The pipeline's stage hands more texts than a sample ever held to the fit, with repeated texts and nulls."""
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat('word', id % 8000, ' tail') AS text", "'en' AS lang", "'s' AS source", "10L AS n_chars")
    docs = docs.unionByName(docs.limit(20).selectExpr("doc_id + 10000 AS doc_id", "CAST(NULL AS string) AS text", "lang", "source", "n_chars"))
    seen = []

    def fit(rows, topics=2):
        texts = rows.where("h IS NOT NULL")
        seen.append((rows.count(), texts.count(), texts.select("h").distinct().count()))
        return mixing.Topics(np.eye(topics, mixing.DIMENSIONS))

    monkeypatch.setattr(mixing, "fit_vectors", fit)
    kept = P.mixed(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < 9020
    assert seen == [(9020, 9000, 8000)]
