import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import bpe, token_counts
from tabularium.llm.common import shared_dir
from tabularium.llm.queries import tokenizer_file

PIECE, WORD = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")


def piece_counts(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    return [len(sp.encode(t or "")) for t in texts]


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_counts_equal_the_library(request, which):
    df = request.getfixturevalue(which)
    got = sorted(token_counts.token_counts(df, PIECE).collect(), key=str)
    src = df.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), n, n > 4096) for r, n in zip(src, piece_counts(r.text for r in src), strict=True)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_only_distinct_misses_are_encoded(spark, docs):
    cache = shared_dir(spark)
    half = docs.where("doc_id % 2 = 0")
    token_counts.fill_cache(half, cache, PIECE)
    distinct = half.select("text").distinct().count()
    assert spark.read.parquet(cache).count() == distinct
    token_counts.fill_cache(half, cache, PIECE)
    assert spark.read.parquet(cache).count() == distinct
    token_counts.token_counts(docs, PIECE, cache)
    assert spark.read.parquet(cache).count() == docs.select("text").distinct().count()
    # Counts of another tokenizer version aren't taken for this one's.
    token_counts.fill_cache(half, cache, WORD)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PIECE, cache).collect()}
    src = docs.select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in src], piece_counts(r.text for r in src), strict=True))


def test_few_and_many_misses_agree(spark, docs):
    half = docs.where("doc_id % 2 = 0")
    stored = []
    for bound in (0, 10**6):
        cache = shared_dir(spark)
        token_counts.fill_cache(half, cache, PIECE)
        token_counts.fill_cache(docs, cache, PIECE, broadcast_digests=bound)
        stored.append(sorted((bytes(r.content_digest), r.n_tokens) for r in spark.read.parquet(cache).collect()))
    assert stored[0] == stored[1] and len(stored[0]) == docs.select("text").distinct().count()


def test_planted_cache_is_used(spark):
    df = spark.createDataFrame([(1, "planted")], "doc_id long, text string")
    cache = shared_dir(spark)
    row = (bytearray(hashlib.sha256(b"planted").digest()), 77, token_counts.tokenizer_digest(PIECE))
    for _ in range(2):  # appended twice, used once
        spark.createDataFrame([row], token_counts.CACHE).write.mode("append").parquet(cache)
    assert [tuple(r) for r in token_counts.token_counts(df, PIECE, cache).collect()] == [(1, 7, 77, False)]


def test_empty(no_docs):
    assert token_counts.token_counts(no_docs, PIECE).count() == 0
    assert bpe.encode_and_decode(no_docs, WORD).count() == 0


def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_bpe_round_trip_equals_the_library(request, which):
    df = request.getfixturevalue(which)
    tok = library()
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, ids, text))
    enc = bpe.encode(df, WORD)
    assert sorted(((r.doc_id, list(r.ids)) for r in enc.collect()), key=str) == sorted(((i, x) for i, x, _ in want), key=str)
    assert sorted(((r.doc_id, r.text) for r in bpe.decode(enc, WORD).collect()), key=str) == sorted(((i, t) for i, _, t in want), key=str)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    rows = sorted((tuple(r) for r in bpe.encode_and_decode(df, WORD).collect()), key=str)
    assert rows == sorted(((i, len(x), digest(np.array(x, "<u4").tobytes()), digest(t.encode())) for i, x, t in want), key=str)


def test_blocks_smaller_than_a_file(docs, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_ROWS", 7)
    monkeypatch.setattr(bpe, "WORDS_HELD", 50)
    whole = {r.doc_id: list(r.ids) for r in bpe.encode(docs, WORD).collect()}
    tok = library()
    assert whole == {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}


def test_decode_null_ids(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.text for r in bpe.decode(df, WORD).collect()} == {""}
    assert bpe.decode(df.withColumn("ids", F.array(F.lit(320)))  , WORD).first().text == library().decode([320], skip_special_tokens=False)
