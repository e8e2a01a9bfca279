"""BPE encoding by a distinct-word table, and decoding by an id-to-piece join.

Encoding splits texts into words at ASCII white space, which the tokenizer's own
splitting never crosses, and encodes each distinct word once:

1. Each task lists the distinct words of its blocks of documents. A block is a run of
   ``BLOCK_ROWS`` rows of one input file, known by the file and the rows' numbers.
   Words are dealt to buckets by a hash; a block's words in a bucket are one packed row.
2. These rows are shuffled by bucket. The library encodes a bucket's distinct words
   once; every block that has them gets their ids.
3. The packed words, now with ids, are written in shards, sorted by block. A block's
   part of the word table is found by its shard's folder and the row groups' statistics.
4. Documents are read again. Each block's rows are joined with its part of the table,
   word by word in the order of their positions, so no text or position is shuffled.

Buckets and shards follow the input's bytes, as the optimizer estimates them, so that
what one task reads doesn't grow with the input up to ``MOST_BUCKETS``.

A hot word costs one entry a block, not one a place, and a task holds the words of one
block. The written table ends the lineage: a lost task reads it again.

Decoding joins ids with the tokenizer's id-to-piece table, whose size is the
vocabulary's, fixed by its file.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.common import file_system, located, shared_dir, small_batches, trimmed, utf8

BLOCK_ROWS = 4096
#: Words that a task holds before it hands a part of a block's list on, and encoded
#: words that it keeps; past that it starts anew, at the price of encoding some again.
WORDS_HELD, WORDS_KNOWN = 1_000_000, 1_000_000
#: Buckets of words: one for so many bytes of input, between these.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 128 << 20, 64, 8192
#: Shards of the word table: one for so many bytes of input, at most so many; and the
#: bytes of a shard's row groups, of which a block reads one or a few.
SHARD_BYTES, MOST_SHARDS, GROUP_BYTES = 64 << 20, 16384, 4 << 20


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _lister(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, block, words): the distinct words of each block, sorted and packed by bucket."""

    def out(block: int, words: set[bytes]) -> pa.RecordBatch:
        dealt: list[list[bytes]] = [[] for _ in range(buckets)]
        for w in words:
            dealt[zlib.crc32(w) % buckets].append(w)
        rows = [(k, block, _pack(b" ".join(sorted(d)))) for k, d in enumerate(dealt) if d]
        kinds = (pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "block", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, set()
        for b in batches:
            for block, text in zip(b.column(0).to_pylist(), utf8(b, "text"), strict=True):
                if (block != now or len(words) > WORDS_HELD) and words:
                    yield out(now, words)
                    words = set()
                now = block
                words.update((text or b"").split())
        if words:
            yield out(now, words)

    return run


def _encoder(tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, words, sizes and ids) for packed words; a task encodes each distinct word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer)
        known: dict[bytes, bytes] = {}
        for b in batches:
            ids = []
            for packed in b.column(2).to_pylist():
                words = _unpack(packed).split()
                if len(known) > WORDS_KNOWN:
                    known.clear()
                new = [w for w in words if w not in known]
                for w, e in zip(new, tok.encode_batch([w.decode() for w in new], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, "<u4").tobytes()
                got = [known[w] for w in words]
                sizes = np.array([len(x) // 4 for x in got], "<u4").tobytes()
                ids.append(_pack(sizes + b"".join(got)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(ids, pa.binary())], names=["block", "words", "ids"])

    return run


def _bytes_of(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def word_table(blocks: DataFrame, tokenizer: str) -> tuple[str, int]:
    """Writes (shard, block, words, ids) for rows (block, text); the folder's URI and the number of shards."""
    spark = blocks.sparkSession
    small_batches(spark)
    size = _bytes_of(blocks)
    buckets = min(max(-(-size // BUCKET_BYTES), LEAST_BUCKETS), MOST_BUCKETS)
    shards = min(max(-(-size // SHARD_BYTES), 1), MOST_SHARDS)
    listed = blocks.select("block", "text").mapInArrow(trimmed(_lister(buckets)), "bucket int, block long, words binary")
    coded = listed.repartition(buckets, "bucket").mapInArrow(trimmed(_encoder(tokenizer)), "block long, words binary, ids binary")
    placed = coded.withColumn("shard", F.pmod("block", F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", "block")
    uri = shared_dir(spark)
    placed.write.option("parquet.block.size", GROUP_BYTES).partitionBy("shard").parquet(uri)
    return uri, shards


def _part_of_table(uri: str, shards: int, block: int) -> dict[bytes, bytes]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = file_system(uri)
    out: dict[bytes, bytes] = {}
    for f in store.get_file_info(fs.FileSelector(f"{path}/shard={block % shards}", allow_not_found=True)):
        if not f.path.endswith(".parquet"):
            continue
        with store.open_input_file(f.path) as src:
            table = pq.ParquetFile(src)
            place = table.schema_arrow.get_field_index("block")
            bounds = [table.metadata.row_group(k).column(place).statistics for k in range(table.num_row_groups)]
            groups = [k for k, s in enumerate(bounds) if s is None or not s.has_min_max or s.min <= block <= s.max]
            for b in table.iter_batches(64, row_groups=groups, columns=["block", "words", "ids"]) if groups else ():
                b = b.filter(pc.equal(b.column(0), block))
                for words, ids in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    words, ids = _unpack(words).split(), _unpack(ids)
                    ends = np.cumsum(np.frombuffer(ids, "<u4", len(words))) * 4 + 4 * len(words)
                    at = 4 * len(words)
                    for w, end in zip(words, ends.tolist(), strict=True):
                        out[w] = ids[at:end]
                        at = end
    return out


def _joined(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, fields: list[T.StructField], columns) -> DataFrame:
    """Rows (id, …): ``columns(got)`` makes arrays of the rows' ids, given as bytes of 4 each."""
    at = located(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    block = F.xxhash64("__file", F.floor(F.col("__row") / BLOCK_ROWS).cast("long"))
    rows = at.select(block.alias("block"), "id", F.coalesce("text", F.lit("")).alias("text"))
    uri, shards = word_table(rows, tokenizer)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                got = []
                for block, text in zip(b.column(0).to_pylist(), utf8(b, "text"), strict=True):
                    words = text.split()
                    if block != now and words:
                        now, known = block, {}
                        known = _part_of_table(uri, shards, block)
                    got.append(b"".join(map(known.__getitem__, words)))
                yield pa.RecordBatch.from_arrays([b.column(1), *columns(got)], names=schema.names)

    return rows.mapInArrow(trimmed(run), schema)


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def _ids_array(got: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in got)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<i4")))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row of ``docs``, as the library encodes the whole text.

    Null texts count as empty and give no ids. Null ids and repeated rows keep their
    rows; other columns are ignored; an empty table gives no rows.
    """
    return _joined(docs, tokenizer, id_col, text_col, [IDS], lambda got: [_ids_array(got)])


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, [ids,] n_tokens, ids_sha256, decoded_sha256): ``encode``, then ``decode`` of its ids, in one task.

    The digests are what is needed to compare with another encoder: of the ids as
    little-endian 32-bit numbers, and of the decoded text in UTF-8. Edge cases as encode.
    """
    sha = lambda x: hashlib.sha256(x).hexdigest()
    table: list[list[bytes | None]] = []

    def columns(got: list[bytes]) -> list[pa.Array]:
        if not table:
            table.append(pieces_of(tokenizer))
        digests = [
            pa.array([len(x) // 4 for x in got], pa.int64()),
            pa.array([sha(x) for x in got], pa.string()),
            pa.array([sha(decode_ids(np.frombuffer(x, "<u4"), table[0])) for x in got], pa.string()),
        ]
        return [_ids_array(got), *digests] if keep_ids else digests

    return _joined(docs, tokenizer, id_col, text_col, [IDS, *DIGESTS] if keep_ids else DIGESTS, columns)


def pieces_of(tokenizer: str) -> list[bytes | None]:
    """The id-to-piece table; None where the vocabulary has no piece."""
    tok = load(tokenizer)
    if tok.decoder is not None:
        raise ValueError("only tokenizers that join plain pieces are decoded here")
    size = max(tok.get_vocab(with_added_tokens=True).values()) + 1
    return [None if (p := tok.id_to_token(i)) is None else p.encode() for i in range(size)]


def _lists(col: pa.Array) -> list[np.ndarray]:
    """Each row's ids; a null row has none."""
    ends, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decode_ids(ids: np.ndarray, pieces: list[bytes | None]) -> bytes:
    """The pieces of the ids, joined by spaces as a tokenizer without a decoder joins them."""
    try:
        return b" ".join(map(pieces.__getitem__, ids.tolist()))
    except TypeError:  # an id without a piece
        return b" ".join(p for p in map(pieces.__getitem__, ids.tolist()) if p is not None)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows with ``ids``; null ids count as none and give the empty text."""
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(tokenizer)
        for b in batches:
            text = pa.array([decode_ids(x, pieces) for x in _lists(b.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), text.cast(pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(trimmed(run), schema)
