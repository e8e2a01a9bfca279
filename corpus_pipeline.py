"""The corpus pipeline: stages over documents, each of one operator of tabularium.llm.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written to the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabularium.llm import bpe, mixing, quality, simhash, toxicity
from tabularium.llm.common import materialize, table
from tabularium.llm.queries import tokenizer_file


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that are predicted toxic go."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that a rule rejects go."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of documents whose five-word shingles are at least 0.8 similar, that with the smallest doc_id stays.

    op3's two bits of one fingerprint miss nearly all of these pairs, so tries of several
    fingerprints propose them and the shingles confirm them.
    """
    return simhash.keep_similar(docs, width=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are sampled towards the target shares of sources, languages and topics."""
    return mixing.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token ids of every whole text, with the digests of ids and decoded text."""
    return bpe.encode_and_decode(docs, tokenizer_file("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("toxicity", civil),
    ("quality rules", good),
    ("SimHash near-dedup", distinct),
    ("mixing", mixed),
    ("BPE", encoded),
]

#: SQL can't express the trained, hashed and encoded stages; tests compare run() with a
#: brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
