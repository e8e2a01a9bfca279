"""Text extraction: decoded chunks of files, under budgets of characters."""

from __future__ import annotations

import codecs
import io
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.text import extension, newline_norm
from tabularium.sources.files import SAMPLE_BYTES, SourceError, encoding_of, open_uri
from tabularium.sources.formats import catalogue_table

CHUNK_BYTES, MAX_CHARS, MAX_FILES = 256 << 10, 64 << 20, 100_000
CHUNKS = "path string, format string, encoding string, index long, text string"


def _encoding(f: pa.NativeFile) -> str:
    sample = f.read_at(min(SAMPLE_BYTES, f.size()), 0)
    if not sample.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)) and 0 in sample:
        raise SourceError("the text holds NUL bytes")
    return encoding_of(sample, final=f.size() <= SAMPLE_BYTES)


def decode_chunks(source: bytes | pa.NativeFile, chunk_bytes: int, max_chars: int) -> Iterator[tuple[str, int, str]]:
    """(encoding, index, text) of a file, read piece by piece; all kinds of line ends become line feeds.

    A line end that a piece's border cuts goes to the next piece, so it stays one.
    """
    f = pa.BufferReader(source) if isinstance(source, bytes) else source
    name = _encoding(f)
    f.seek(0)
    lines = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder(name)("strict"), translate=True)
    pieces = iter(lambda: f.read(chunk_bytes), b"")
    texts = (t for t in chain((lines.decode(p) for p in pieces), (lines.decode(b"", final=True) for _ in (0,))) if t)
    for index, text in enumerate(texts):
        if max_chars > 0:
            yield name, index, text[:max_chars]
        max_chars -= len(text)
        if max_chars <= 0:
            break


def extract_files(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, max_chars: int = MAX_CHARS) -> DataFrame:
    """(path, format, encoding, index, text) chunks of all text files of a path.

    A task opens its files and reads them piece by piece; no file is held as a whole.
    """
    if not 1024 <= chunk_bytes <= 4 << 20 or not 1 <= max_chars <= 1 << 30:
        raise SourceError("chunks have 1 KiB to 4 MiB, a file 1 to 2^30 characters")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumn("extension", extension(F.col("path")))
    known = catalogue_table(spark).where("level in ('extract', 'train') and modality in ('text', 'table')")
    files = files.join(F.broadcast(known), "extension").select("path", F.substring("extension", 2, 32).alias("format"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, kind in zip(b["path"], b["format"], strict=True):
                with open_uri(p) as f:
                    for enc, k, t in decode_chunks(f, chunk_bytes, max_chars):
                        yield pd.DataFrame({"path": [p], "format": [kind], "encoding": [enc], "index": [k], "text": [t]})

    return files.mapInPandas(run, CHUNKS)


def text_chunks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, index, chunk): a text column cut into pieces of ``size`` characters, line ends normalised."""
    t = newline_norm(F.col(text))
    n = F.floor((F.length("t") + size - 1) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = docs.select(F.col(key), t.alias("t")).select(key, "t", F.explode(starts).alias("index"))
    return rows.select(key, "index", F.substring(F.col("t"), F.col("index") * size + 1, F.lit(size)).alias("chunk"))


def within_budget(chunks: DataFrame, order: list[str], text: str, budget: int) -> DataFrame:
    """Chunks in order up to a number of characters over all of them; the last one is cut.

    Blocks of the leading column are summed first, so no task sees all texts: only
    chunks' lengths go through the running sum.
    """
    from tabularium.operators.order import with_running_sum

    sized = with_running_sum(chunks.withColumn("__n", F.length(text)), order, "__n", "__upto")
    before = F.col("__upto") - F.col("__n")
    kept = sized.where(before < budget)
    return kept.withColumn(text, F.substring(F.col(text), F.lit(1), F.least(F.col("__n").cast("long"), F.lit(budget) - before).cast("int"))).drop("__n", "__upto")


def folder_budget(chunks: DataFrame, budget: int) -> DataFrame:
    """``within_budget`` for extracted chunks in the order of lower-case paths.

    Files are summed by path first; their totals are a row per file.
    """
    sizes = chunks.groupBy("path").agg(F.sum(F.length("text")).alias("n"))
    w = Window.orderBy(F.lower("path"), "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    files = sizes.withColumn("before", F.sum("n").over(w) - F.col("n")).where(F.col("before") < budget)
    own = Window.partitionBy("path").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = chunks.join(files.select("path", "before"), "path").withColumn("at", F.col("before") + F.sum(F.length("text")).over(own) - F.length("text"))
    left = F.lit(budget) - F.col("at")
    return rows.where(left > 0).withColumn("text", F.substring(F.col("text"), F.lit(1), left.cast("int"))).drop("before", "at")
