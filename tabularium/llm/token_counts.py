"""Token counts through a digest cache.

The cache is a Parquet folder of (tokenizer_digest, content_digest, n_tokens). A count
belongs to the SHA-256 of the normalised content and to the SHA-256 of the tokenizer's
version (its file and settings), so another tokenizer never meets old counts. A run
joins the two digests to the cache, encodes each distinct content that is missing
once, appends those counts, and reads all counts from the cache by a second join.

Where the cache already has counts, digests meet it before any text moves: texts with a
stored count stay where they are, if the missing digests are few enough to broadcast
(``BROADCAST_DIGESTS``, counted first); else texts are shuffled and joined there.

Texts are moved once: repeated contents are dropped in each scan task before the
shuffle by digest, so a group of copies sends one text per task at most. The last join
moves digests only, and Spark splits its skewed partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import materialize, shared_dir, trimmed, utf8

#: Missing digests that are broadcast at most: some 100 MB in an executor.
BROADCAST_DIGESTS = 500_000
CACHE = "content_digest binary, n_tokens long, tokenizer_digest string"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file's bytes, its kind and the encoding settings."""
    h = hashlib.sha256(b"no begin, end, padding or truncation\0" + Path(path).suffix.encode() + b"\0")
    h.update(Path(path).read_bytes())
    return h.hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts as the file's own library does."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def normalised(text_col: str = "text"):
    """The content whose digest is the key: null is empty.

    Nothing more is folded: a tokenizer without a normaliser gives other counts for
    texts that differ in white space, case or composition.
    """
    return F.coalesce(F.col(text_col), F.lit(""))


def digest_of(text_col: str = "text"):
    return F.unhex(F.sha2(normalised(text_col).cast("binary"), 256))


def _read(spark: SparkSession, cache: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest the task hasn't met yet. Holds 16 bytes a distinct digest of one task."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for i, d in enumerate(b.column(0).to_pylist()):
            if d[:16] not in seen:
                seen.add(d[:16])
                keep.append(i)
        if keep:
            yield b.take(pa.array(keep))


def fill_cache(docs: DataFrame, cache: str, tokenizer: str, text_col: str = "text", broadcast_digests: int = BROADCAST_DIGESTS) -> None:
    """Encodes the distinct contents of ``docs`` that the cache lacks and appends their counts."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    known = _read(spark, cache).where(F.col("tokenizer_digest") == version).select("content_digest")
    texts = docs.select(digest_of(text_col).alias("content_digest"), normalised(text_col).alias("text"))
    few = None
    if not known.isEmpty():
        lacking = materialize(texts.select("content_digest").distinct().join(known, "content_digest", "left_anti"))
        if lacking.count() <= broadcast_digests:
            few = texts.join(F.broadcast(lacking), "content_digest", "left_semi")
    once = (texts if few is None else few).mapInArrow(trimmed(_first_of_task), "content_digest binary, text string").repartition("content_digest")
    missing = once.join(known, "content_digest", "left_anti") if few is None else once

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in _first_of_task(batches):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n = count([t.decode("utf-8", "replace") for t in utf8(part, "text")])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["content_digest", "n_tokens"])

    counts = missing.mapInArrow(trimmed(encode), "content_digest binary, n_tokens long")
    counts.withColumn("tokenizer_digest", F.lit(version)).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit.

    ``cache`` is a URI that all executors reach; without one a new folder of the shared
    directory is used, so every distinct content is a miss. A null text counts as empty:
    zero bytes and the library's count of the empty text. Null ids and repeated rows
    keep their rows; other columns are ignored; an empty table gives no rows. A count
    that was appended twice (two runs at a time, a repeated append) is used once.
    """
    uri = cache or shared_dir(docs.sparkSession)
    fill_cache(docs, uri, tokenizer, text_col)
    stored = _read(docs.sparkSession, uri).where(F.col("tokenizer_digest") == tokenizer_digest(tokenizer))
    if cache:  # of a kept cache only what this run asks for
        stored = stored.join(docs.select(digest_of(text_col).alias("content_digest")).distinct(), "content_digest", "left_semi")
    # Written before the join: Spark splits a skewed join only between plain shuffles.
    counts = materialize(stored.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")))
    keys = docs.select(F.col(id_col), F.octet_length(normalised(text_col)).cast("long").alias("n_bytes"), digest_of(text_col).alias("content_digest"))
    return keys.join(counts, "content_digest", "left").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
