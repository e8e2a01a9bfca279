"""WARC archives and a two-level capture index.

``write_archives`` writes a WARC/1.1 record per page, gzip member by member, into
segment files of the shared folder, and returns the captures: where each record lies.
A payload of ``REVISIT_BYTES`` or more that several pages share is stored once; the
other pages' records are revisits that name the first.

``write_index`` sorts captures by their url's key, host reversed, into blocks of
compressed lines, shard by shard, and writes each shard's block directory: the first
key, place and size of every block. That is the sparse level; a lookup searches the
shards' first keys, then a directory, reads one block by its byte range and searches
its lines. ``lookup`` does this for a table of urls, ``fetch`` reads records by their
byte ranges, neighbours in one go.

Segments, shards and directories get names that no other attempt uses. A task that ran
twice leaves files that no capture or directory row names; nothing reads them.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.common import file_system, located, materialize, shared_dir, trimmed

REVISIT_BYTES = 100
SEGMENT_BYTES = 256 << 20
BLOCK_LINES = 256
#: Bytes of records that a task reads back.
TASK_BYTES = 32 << 20
#: Records whose gap is at most this are read in one range of at most ``READ_BYTES``.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: The tables have no capture time; records carry this one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page string, segment string, offset long, size long, type string, digest string"


def surt(url: Column) -> Column:
    """The sort key of a url: host labels reversed, joined by commas, ``)``, then path and query.

    ``https://www.Example.org/a?b`` gives ``org,example,www)/a?b``; null gives the empty key.
    """
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    tail = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)
    # Keys are lines of a text block: no control characters or blanks in them.
    return F.regexp_replace(F.when(url.isNull(), F.lit("")).otherwise(key), r"[\x00-\x20\x7f]", "%20")


def _clean(value: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def _field(value: str) -> str:
    """A page id as a header's value; ``unquote`` gives it back, blanks and line ends included."""
    return quote(value, safe="")


def _urn(file: int, row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'%d/%d' % (file, row)).digest()[:16])}>"


def record(page: str | None, url: str | None, payload: bytes, digest: str, urn: str, refers: tuple[str | None, str] | None) -> bytes:
    """One WARC record. ``refers`` is (page, urn) of the record that a revisit refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {urn}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url) or 'about:blank'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {_field(page)}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers[1]}"]
        if refers[0] is not None:
            head.append(f"X-Refers-To-Page-ID: {_field(refers[0])}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record (names in lower case), of its HTTP block, and the HTTP body."""

    def fields(block: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in block.decode().split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, _, v in pairs}

    at = raw.index(b"\r\n\r\n")
    head = fields(raw[:at])
    if not raw.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    block = raw[at + 4 : at + 4 + int(head["content-length"])]
    if raw[at + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    cut = block.index(b"\r\n\r\n")
    return head, fields(block[:cut]), block[cut + 4 :]


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages' records below ``uri`` and returns their captures (``CAPTURE``).

    Of equal payloads the row with the smallest page id is the response; among rows that
    repeat that id, or that all lack one, the first by file and row. Only groups of equal
    payloads take part in the join that tells rows what they refer to.
    """
    at = located(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload")))
    rows = at.select("id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n"), "__file", "__row")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "__file", "__row")
    groups = materialize(
        rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min(order).alias("f"), F.count("*").alias("k")).where("k > 1").select("digest", "f")
    )
    first = (F.col("f.__file") == F.col("__file")) & (F.col("f.__row") == F.col("__row"))
    told = rows.join(groups, "digest", "left").select(
        surt(F.col("url")).alias("key"), F.col("id").cast("string").alias("page"), "url", "payload", "digest", "__file", "__row",
        (F.col("f").isNotNull() & ~first).alias("revisit"), F.col("f.id").cast("string").alias("to_page"), F.col("f.__file").alias("to_file"), F.col("f.__row").alias("to_row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(uri)
        out, name, at = None, "", 0
        try:
            for b in batches:
                done = []
                for r in b.to_pylist():
                    if out is None or at > SEGMENT_BYTES:
                        if out:
                            out.close()
                        name, at = f"seg-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    urn = _urn(r["__file"], r["__row"])
                    refers = (r["to_page"], _urn(r["to_file"], r["to_row"])) if r["revisit"] else None
                    member = _gzip(record(r["page"], r["url"], r["payload"], r["digest"], urn, refers))
                    out.write(member)
                    done.append((r["key"], r["page"], name, at, len(member), "revisit" if refers else "response", r["digest"]))
                    at += len(member)
                if done:
                    yield _batch(done, CAPTURE)
        finally:
            if out:
                out.close()

    store, root = file_system(uri)
    store.create_dir(root, recursive=True)
    return materialize(told.mapInArrow(trimmed(run), CAPTURE))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write_index(captures: DataFrame, uri: str) -> DataFrame:
    """Writes index shards below ``uri``; returns one row per shard (shard, first, last).

    A shard's file holds its blocks; its directory lies beside it. Keys that many
    captures share may go over several blocks and shards.
    """
    ordered = captures.repartitionByRange("key", "segment", "offset").sortWithinPartitions("key", "segment", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(uri)
        name, out, at = uuid.uuid4().hex, None, 0
        directory: list[tuple[str, int, int]] = []
        lines: list[str] = []
        first = last = None

        def flush():
            nonlocal at
            block = zlib.compress("\n".join(lines).encode())
            out.write(block)
            directory.append((lines[0].partition(" ")[0], at, len(block)))
            at += len(block)
            lines.clear()

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    out, first = store.open_output_stream(f"{root}/{name}.blocks", compression=None), r["key"]
                last = r["key"]
                lines.append(f"{r['key']} " + json.dumps([r["page"], r["segment"], r["offset"], r["size"], r["type"], r["digest"]]))
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with store.open_output_stream(f"{root}/{name}.directory", compression=None) as d:
                d.write(zlib.compress(json.dumps(directory).encode()))
            yield _batch([(name, first, last)], "shard string, first string, last string")

    store, root = file_system(uri)
    store.create_dir(root, recursive=True)
    return materialize(ordered.mapInArrow(trimmed(run, 0), "shard string, first string, last string"))


class Shard:
    """An index shard: its directory in memory, its blocks read by range."""

    def __init__(self, uri: str, name: str):
        store, root = file_system(uri)
        with store.open_input_stream(f"{root}/{name}.directory", compression=None) as d:
            self.directory = json.loads(zlib.decompress(d.read()))
        self.keys = [k for k, _, _ in self.directory]
        self.file = store.open_input_file(f"{root}/{name}.blocks")
        self.at, self.lines = -1, []

    def _block(self, k: int) -> list[str]:
        if k != self.at:
            _, offset, size = self.directory[k]
            self.file.seek(offset)
            self.at, self.lines = k, zlib.decompress(self.file.read(size)).decode().split("\n")
        return self.lines

    def find(self, key: str) -> Iterator[tuple]:
        """(page, segment, offset, size, type, digest) of every capture of the key."""
        # The key may begin in the block before the first one whose first key reaches it.
        k = max(bisect.bisect_left(self.keys, key) - 1, 0)
        while k < len(self.keys) and self.keys[k] <= key:
            lines = self._block(k)
            at = bisect.bisect_left(lines, key + " ")
            while at < len(lines) and lines[at].startswith(key + " "):
                yield tuple(json.loads(lines[at][len(key) + 1 :]))
                at += 1
            k += 1


def lookup(keys: DataFrame, shards: DataFrame, uri: str) -> DataFrame:
    """Captures (``CAPTURE``) of the distinct ``key`` values of a table.

    The list of shards, a row for each index file, is what goes to all tasks.
    """
    # Spark's order of strings, by their UTF-8 bytes, is Python's order of str.
    known = sorted((r.first, r.last, r.shard) for r in shards.collect())
    firsts, lasts = [k[0] for k in known], [k[1] for k in known]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key in b.column(0).to_pylist():
                for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    rows.append((known[k][2], key))
            if rows:
                yield _batch(rows, "shard string, key string")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for b in batches:
            found = []
            for name, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != now:
                    now, shard = name, Shard(uri, name)
                found += [(key, *x) for x in shard.find(key)]
            for lo in range(0, len(found), 10_000):
                yield _batch(found[lo : lo + 10_000], CAPTURE)

    routed = keys.select("key").where("key is not null").distinct().mapInArrow(trimmed(route, 0), "shard string, key string")
    return routed.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(trimmed(search, 0), CAPTURE)


FETCHED = "key string, page string, type string, payload_bytes long, digest string, refers_to string, payload binary"


def fetch(captures: DataFrame, uri: str, with_payload: bool = True) -> DataFrame:
    """The records of captures, read by byte range (``FETCHED``).

    A response's size and digest are computed from the payload that was read and must
    equal what its headers say; a revisit's come from its headers, its payload is null.
    """
    near = materialize(captures.select("key", "segment", "offset", "size", F.floor(F.col("offset") / TASK_BYTES).alias("part")))
    # Captures are tiny next to the records that they name: the number of tasks follows from the records' bytes.
    tasks = max(1, -(-(near.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES), min(near.select("segment", "part").distinct().count(), near.sparkSession.sparkContext.defaultParallelism))

    def read(store, path: str, rows: list[tuple]) -> Iterator[tuple]:
        with store.open_input_file(path) as f:
            lo = 0
            while lo < len(rows):
                hi, start = lo + 1, rows[lo][1]
                end = start + rows[lo][2]
                while hi < len(rows) and rows[hi][1] - end <= GAP_BYTES and rows[hi][1] + rows[hi][2] - start <= READ_BYTES:
                    end = max(end, rows[hi][1] + rows[hi][2])
                    hi += 1
                f.seek(start)
                data = f.read(end - start)
                for key, offset, size in rows[lo:hi]:
                    head, http, body = parse_record(zlib.decompress(data[offset - start : offset - start + size], 31))
                    stated = head["warc-payload-digest"].removeprefix("sha256:")
                    if head["warc-type"] == "response":
                        digest, n = hashlib.sha256(body).hexdigest(), len(body)
                        if (digest, n) != (stated, int(http["content-length"])):
                            raise ValueError(f"payload at {path}:{offset} differs from its header")
                    else:
                        digest, n, body = stated, int(http["content-length"]), None
                    page, to_page = (None if x is None else unquote(x) for x in (head.get("x-page-id"), head.get("x-refers-to-page-id")))
                    yield key, page, head["warc-type"], n, digest, to_page, body if with_payload else None
                lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(uri)
        for b in batches:
            by: dict[str, list[tuple]] = {}
            for key, segment, offset, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                by.setdefault(segment, []).append((key, offset, size))
            out, held = [], 0
            for segment, rows in by.items():
                for x in read(store, f"{root}/{segment}", sorted(rows, key=lambda r: r[1])):
                    out.append(x)
                    held += len(x[6] or b"")
                    if len(out) == 2_000 or held > READ_BYTES:
                        yield _batch(out, FETCHED)
                        out, held = [], 0
            if out:
                yield _batch(out, FETCHED)

    return near.repartition(tasks, "segment", "part").sortWithinPartitions("segment", "offset").mapInArrow(trimmed(run, 0), FETCHED)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes archives and index of all pages, then reads every page's record back through the index.

    One row per row of ``pages``: id, payload_bytes, payload_digest, record_type,
    refers_to. A null html is an empty payload; a null url has the empty key. A null
    id sorts behind all others. Repeated rows have a record each: one may be the
    response that the others revisit. Other columns are ignored; an empty table gives
    no rows.
    """
    folder = folder or shared_dir(pages.sparkSession)
    captures = write_archives(pages, f"{folder}/archives", id_col, url_col, html_col)
    shards = write_index(captures, f"{folder}/index")
    found = lookup(pages.select(surt(F.col(url_col)).alias("key")), shards, f"{folder}/index")
    kind: T.DataType = pages.schema[id_col].dataType
    return fetch(found, f"{folder}/archives", with_payload=False).select(
        F.col("page").cast(kind).alias(id_col), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"),
    )
