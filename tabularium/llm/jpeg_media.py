"""Baseline JPEG media columns.

``to_media`` stores a payload losslessly as a baseline JPEG: a grey image ``WIDTH``
blocks wide whose every 8x8 block is flat, its DC coefficient one payload byte. With a
DC quantiser of 8 a flat block's samples are exactly that byte, so any baseline decoder
shows the payload eight times enlarged, and the DC-only thumbnail is the payload.

``read_media`` parses the markers of any baseline JPEG, Huffman-decodes its scan,
rebuilds the DC-only luminance thumbnail in numpy and derives dimensions and hashes.
Scans of one component whose blocks hold no AC coefficients are decoded in lock-step
over all restart intervals of a batch; other scans go through a symbol-by-symbol decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.common import shared_dir, trimmed, utf8

#: Blocks in a row of the image; one restart interval is one row.
WIDTH = 192
#: Rows in one image (a JPEG's height is below 65,536 samples); longer payloads are
#: stored as several images, one behind the other.
MAX_ROWS = 8191
#: Payload bytes that are coded at once.
AT_ONCE = 2_000_000
#: DC Huffman table: the categories with codes of 1, 2, ... bits, in order. Short codes
#: go to the steps between letters and between letters and blanks.
DC_CODES = ((), (7, 4), (3, 2), (1, 0, 5), (), (6, 8))
#: AC Huffman table: one symbol, the end of the block, as the code 0.
AC_CODES = ((0,),)


def canonical(codes: tuple[tuple[int, ...], ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits) of a table given by its symbols of each length."""
    out, code = {}, 0
    for n, symbols in enumerate(codes, 1):
        code <<= 1
        for s in symbols:
            out[s] = (code, n)
            code += 1
    return out


#: Tables that a process has built. (A decorated cache couldn't travel to workers by value.)
_built: dict[object, object] = {}


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a flat block, by its DC step + 255."""
    if "codes" in _built:
        return _built["codes"]
    dc, (eob, eob_bits) = canonical(DC_CODES), canonical(AC_CODES)[0]
    code, bits = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        c, n = dc[s]
        extra = d if d >= 0 else d + (1 << s) - 1
        code[d + 255] = (c << s | extra) << eob_bits | eob
        bits[d + 255] = n + s + eob_bits
    _built["codes"] = code, bits
    return code, bits


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, codes: tuple[tuple[int, ...], ...]) -> bytes:
    counts = [len(c) for c in codes] + [0] * (16 - len(codes))
    return _segment(0xC4, bytes([kind << 4, *counts, *(s for c in codes for s in c)]))


def header(rows: int, comment: bytes = b"") -> bytes:
    """All of an image before its scan's data."""
    return b"".join([
        b"\xff\xd8",
        _segment(0xFE, comment) if comment else b"",
        _segment(0xDB, bytes([0, 8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0)),
        _table(0, DC_CODES),
        _table(1, AC_CODES),
        _segment(0xDD, struct.pack(">H", WIDTH)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def encode_scans(frames: list[bytes]) -> list[bytes]:
    """Scan data and end marker of each frame; a frame's length is a multiple of WIDTH."""
    code, bits = _code_tables()
    rows = np.frombuffer(b"".join(frames), np.uint8).reshape(-1, WIDTH).astype(np.int16)
    step = np.empty_like(rows)
    step[:, 0] = rows[:, 0] - 128
    step[:, 1:] = rows[:, 1:] - rows[:, :-1]
    step += 255
    n = bits[step]
    ends = np.cumsum(n, axis=1)
    total = ends[:, -1]
    size = (total + 7) >> 3
    start = np.cumsum(size) - size
    at = (ends - n) + (start * 8)[:, None]
    word = code[step] << (24 - n - (at & 7)).astype(np.uint32)
    sums = np.bincount((at >> 3).ravel(), weights=word.ravel(), minlength=int(size.sum()) + 2).astype(np.uint32)
    data = (sums >> 16).astype(np.uint8)
    data[1:] += (sums[:-1] >> 8 & 255).astype(np.uint8)
    data[2:] += (sums[:-2] & 255).astype(np.uint8)
    data = data[: int(size.sum())]
    data[start + size - 1] |= ((1 << (size * 8 - total)) - 1).astype(np.uint8)
    full = data == 255
    before = np.cumsum(full) - full
    row = np.repeat(np.arange(len(size)), size)
    to = np.arange(len(data)) + before + 2 * row
    out = np.zeros(len(data) + int(full.sum()) + 2 * len(size), np.uint8)
    out[to] = data
    # A restart marker stands behind each row, the end of the image behind its last.
    last = start + size - 1
    mark = to[last] + 1 + full[last]
    heights = np.array([len(f) // WIDTH for f in frames])
    first = np.cumsum(heights) - heights
    out[mark] = 0xFF
    out[mark + 1] = 0xD0 + ((np.arange(len(size)) - np.repeat(first, heights)) & 7)
    close = mark[first + heights - 1]
    out[close + 1] = 0xD9
    whole, stops = out.tobytes(), (close + 2).tolist()
    return [whole[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def pad(payload: bytes) -> bytes:
    """The payload with blanks up to a positive multiple of WIDTH."""
    short = -len(payload) % WIDTH if payload else WIDTH
    return payload + b" " * short


def encode_media(payloads: list[bytes]) -> list[bytes]:
    """Each payload, padded, as one or more baseline JPEGs; a comment keeps its own length."""
    frames, owner = [], []
    for k, p in enumerate(payloads):
        whole = pad(p)
        for at in range(0, len(whole), WIDTH * MAX_ROWS):
            frames.append(whole[at : at + WIDTH * MAX_ROWS])
            owner.append(k)
    out: list[list[bytes]] = [[] for _ in payloads]
    lo = 0
    while lo < len(frames):
        hi, held = lo, 0
        while hi < len(frames) and (hi == lo or held + len(frames[hi]) <= AT_ONCE):
            held += len(frames[hi])
            hi += 1
        for k, f, scan in zip(owner[lo:hi], frames[lo:hi], encode_scans(frames[lo:hi]), strict=True):
            note = b"" if out[k] else b"n_bytes=%d" % len(payloads[k])
            out[k].append(header(len(f) // WIDTH, note) + scan)
        lo = hi
    return [b"".join(x) for x in out]


@dataclass
class Image:
    """What the markers before a scan say."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    restart: int = 0
    quant: dict[int, int] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    #: component id -> (horizontal, vertical sampling, quantiser)
    parts: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    #: components of the scan: (id, DC table, AC table)
    scan: list[tuple[int, int, int]] = field(default_factory=list)
    data: np.ndarray | None = None
    end: int = 0


def parse(media: bytes, at: int = 0) -> Image:
    """The image that begins at ``at``; ValueError for what isn't a one-scan baseline JPEG."""
    im = Image()
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    while True:
        if media[at] != 0xFF:
            raise ValueError("no marker")
        kind = media[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        n = int.from_bytes(media[at + 2 : at + 4], "big")
        body = media[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xC0:
            if body[0] != 8:
                raise ValueError("not 8 bits a sample")
            im.height, im.width = struct.unpack(">HH", body[1:5])
            for k in range(body[5]):
                c, hv, q = body[6 + 3 * k : 9 + 3 * k]
                im.parts[c] = (hv >> 4, hv & 15, q)
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif kind == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                im.tables[body[0]] = body[1:size]
                body = body[size:]
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                im.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xDD:
            im.restart = int.from_bytes(body, "big")
        elif kind == 0xFE:
            im.comment = body
        elif kind == 0xDA:
            im.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            break
    im.data = np.frombuffer(media, np.uint8, offset=at)
    im.end = at
    return im


def split_scan(im: Image) -> list[np.ndarray]:
    """The data of each restart interval without stuffed bytes; sets ``im.end`` behind the image."""
    data = im.data
    ff = np.flatnonzero(data[:-1] == 0xFF)
    nxt = data[ff + 1]
    marks = ff[nxt != 0]
    kinds = nxt[nxt != 0]
    stop = np.flatnonzero((kinds < 0xD0) | (kinds > 0xD7))
    if not len(stop) or kinds[stop[0]] != 0xD9:
        raise ValueError("no end of image")
    marks = marks[: stop[0] + 1]
    end = marks[-1]
    im.end += int(end) + 2
    stuffed = ff[(nxt == 0) & (ff < end)] + 1
    gone = np.concatenate([stuffed, marks[:-1], marks[:-1] + 1])
    body = np.delete(data[:end], gone)
    cuts = marks[:-1] - np.searchsorted(stuffed, marks[:-1]) - 2 * np.arange(len(marks) - 1)
    return np.split(body, cuts)


def _symbols(table: bytes) -> dict[int, tuple[int, int]]:
    codes, at = [], 16
    for n in table[:16]:
        codes.append(tuple(table[at : at + n]))
        at += n
    return canonical(tuple(codes))


def _flat_table(dc: bytes, ac: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the bits of a whole flat block (0: none) and its DC step."""
    if (dc, ac) in _built:
        return _built[dc, ac]
    bits, step = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int16)
    eob = _symbols(ac).get(0)
    for s, (code, n) in _symbols(dc).items() if eob else ():
        if s > 11 or n + s + eob[1] > 16:
            continue
        for extra in range(1 << s):
            size = n + s + eob[1]
            lo = ((code << s | extra) << eob[1] | eob[0]) << (16 - size)
            bits[lo : lo + (1 << (16 - size))] = size
            step[lo : lo + (1 << (16 - size))] = extra if not s or extra >> (s - 1) else extra - (1 << s) + 1
    if len(_built) > 16:
        _built.clear()
    _built[dc, ac] = bits, step
    return bits, step


def _lookup(table: bytes) -> dict[tuple[int, int], int]:
    return {(n, code): s for s, (code, n) in _symbols(table).items()}


def decode_any(im: Image, intervals: list[np.ndarray]) -> np.ndarray:
    """Quantised luminance DC values (rows, columns of blocks), symbol by symbol."""
    single = len(im.scan) == 1
    hmax, vmax = max(p[0] for p in im.parts.values()), max(p[1] for p in im.parts.values())
    luma = im.scan[0][0]
    h, v = (1, 1) if single else im.parts[luma][:2]
    scale_x, scale_y = (8, 8) if single else (8 * hmax, 8 * vmax)
    across, down = -(-im.width // scale_x), -(-im.height // scale_y)
    out = np.zeros((down * v, across * h), np.int64)
    left, mcu = across * down, 0
    tables = {k: _lookup(t) for k, t in im.tables.items()}
    for part in intervals:
        word, room, at = int.from_bytes(part.tobytes(), "big"), 8 * len(part), 0

        def take(n: int) -> int:
            nonlocal at
            at += n
            if at > room:
                raise ValueError("scan ends early")
            return word >> (room - at) & ((1 << n) - 1)  # noqa: B023

        def symbol(table: dict[tuple[int, int], int]) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)  # noqa: B023
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("no such code")

        pred = dict.fromkeys((c for c, _, _ in im.scan), 0)
        for _ in range(min(im.restart or left, left - mcu)):
            for c, dc, ac in im.scan:
                ch, cv = (1, 1) if single else im.parts[c][:2]
                for k in range(ch * cv):
                    s = symbol(tables[dc])
                    if s:
                        x = take(s)
                        pred[c] += x if x >> (s - 1) else x - (1 << s) + 1
                    if c == luma:
                        out[mcu // across * v + k // ch, mcu % across * h + k % ch] = pred[c]
                    z = 1
                    while z < 64:
                        rs = symbol(tables[16 | ac])
                        if rs == 0:
                            break
                        take(rs & 15)
                        z += (rs >> 4) + 1
            mcu += 1
    if mcu != left:
        raise ValueError("scan ends early")
    return out[: -(-im.height // 8), : -(-im.width // 8)]


def decode_flat(images: list[tuple[Image, list[np.ndarray]]]) -> list[np.ndarray | None]:
    """As decode_any for one-component images of equal tables, in lock-step; None for one that isn't flat."""
    first = images[0][0]
    bits, step = _flat_table(first.tables[first.scan[0][1]], first.tables[16 | first.scan[0][2]])
    parts = [p for _, x in images for p in x]
    sizes = np.array([len(p) for p in parts])
    data = np.concatenate([*parts, np.full(4, 255, np.uint8)]).astype(np.uint32)
    words = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    counts = []
    for im, x in images:
        blocks = -(-im.width // 8) * -(-im.height // 8)
        every = im.restart or blocks
        counts += [min(every, blocks - k * every) for k in range(len(x))]
    counts = np.array(counts)
    ends = np.cumsum(sizes) * 8
    pos = ends - sizes * 8
    longest = int(counts.max())
    got = np.zeros((len(parts), longest), np.int16)
    bad = np.zeros(len(parts), bool)
    even = (counts == longest).all()
    for k in range(longest):
        p = np.minimum(pos, ends - 1)
        w = (words[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF
        n = bits[w]
        on = slice(None) if even else counts > k
        bad |= (n == 0) if even else (n == 0) & on
        got[on, k] = step[w[on]]
        if even:
            pos = pos + n
        else:
            pos[on] += n[on]
    bad |= pos > ends
    got = np.cumsum(got, axis=1, dtype=np.int32)
    out, at = [], 0
    for im, x in images:
        rows, cols = -(-im.height // 8), -(-im.width // 8)
        own = slice(at, at + len(x))
        at += len(x)
        if bad[own].any() or counts[own].sum() != rows * cols or (counts[own] < 0).any():
            out.append(None)
        else:
            out.append(got[own].reshape(rows, cols) if even and longest == cols else np.concatenate([g[:c] for g, c in zip(got[own], counts[own], strict=True)]).reshape(rows, cols))
    return out


def thumbnails(medias: list[bytes]) -> list[tuple[np.ndarray, int, int, bytes]]:
    """(DC-only luminance thumbnail, width, height, comment) of each media; stacked images become one."""
    found, owner = [], []
    for k, m in enumerate(medias):
        at = 0
        while at < len(m):
            im = parse(m, at)
            found.append((im, split_scan(im)))
            owner.append(k)
            at = im.end
    dc: list[np.ndarray | None] = [None] * len(found)
    alike: dict[tuple[bytes, bytes], list[int]] = {}
    for k, (im, _) in enumerate(found):
        if len(im.scan) == 1:
            alike.setdefault((im.tables[im.scan[0][1]], im.tables[16 | im.scan[0][2]]), []).append(k)
    for same in alike.values():
        lo = 0
        while lo < len(same):
            hi, held = lo, 0
            while hi < len(same) and (hi == lo or held < AT_ONCE):
                held += sum(map(len, found[same[hi]][1]))
                hi += 1
            for k, x in zip(same[lo:hi], decode_flat([found[k] for k in same[lo:hi]]), strict=True):
                dc[k] = x
            lo = hi
    out: list[list] = [[] for _ in medias]
    for k, (im, intervals) in enumerate(found):
        x = dc[k] if dc[k] is not None else decode_any(im, intervals)
        luma = np.clip((x * im.quant[im.parts[im.scan[0][0]][2]] + 4) // 8 + 128, 0, 255).astype(np.uint8)
        out[owner[k]].append((luma, im))
    return [(x[0][0] if len(x) == 1 else np.vstack([y for y, _ in x]), x[0][1].width, sum(im.height for _, im in x), x[0][1].comment) for x in out]


def thumbnail_hash(luma: np.ndarray) -> str:
    """A difference hash: 16 hex digits, one bit for each pair of neighbours in an 8x9 reduction."""
    rows = np.minimum(np.arange(8) * luma.shape[0] // 8, luma.shape[0] - 1)
    cols = np.minimum(np.arange(9) * luma.shape[1] // 9, luma.shape[1] - 1)
    small = np.add.reduceat(np.add.reduceat(luma, rows, axis=0, dtype=np.int64), cols, axis=1)
    high = np.diff(np.r_[rows, luma.shape[0]]).clip(1)[:, None]
    wide = np.diff(np.r_[cols, luma.shape[1]]).clip(1)[None, :]
    mean = small / (high * wide)
    return np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()


def _like(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media) for every row: its text's UTF-8 bytes, padded with blanks, as baseline JPEG.

    Null and empty texts are 192 blanks. Null ids and repeated rows keep their rows;
    other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                media = encode_media([x or b"" for x in utf8(b, "__text")])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=[id_col, "media"])

    schema = T.StructType([T.StructField(id_col, _like(docs, id_col)), T.StructField("media", T.BinaryType())])
    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(trimmed(run), schema)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uri: str | None = None) -> DataFrame:
    """``to_media`` written as Parquet to ``uri`` (else a new shared folder); the stored rows (id, media)."""
    spark = docs.sparkSession
    uri = uri or shared_dir(spark)
    media = to_media(docs, id_col, text_col)
    media.write.option("compression", "zstd").parquet(uri)
    return spark.read.schema(media.schema).parquet(uri)


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Dimensions, payload and hashes of rows (id, media), all from the stored bytes.

    Columns: id, width, height, n_bytes (from the comment; null without one), payload
    digests, media_bytes, media_sha256, feature (dimensions and thumbnail hash) and error.
    A null media gives nulls; one that isn't a baseline JPEG gives nulls and an error.
    """
    fields = ["width int", "height int", "n_bytes long", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string", "error string"]
    names = [f.split()[0] for f in fields]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in fields]

    def row(m: bytes, x: tuple[np.ndarray, int, int, bytes]) -> tuple:
        luma, width, height, note = x
        payload = luma.tobytes()
        n = int(note[8:]) if note.startswith(b"n_bytes=") else None
        return (
            width, height, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
            len(m), hashlib.sha256(m).hexdigest(), f"{width}x{height}:{thumbnail_hash(luma)}", None,
        )

    def rows_of(raw: list[bytes | None]) -> list[tuple]:
        """Rows of a slice; one that can't be decoded as a whole is halved down to the faulty media."""
        given = [m for m in raw if m is not None]
        try:
            seen = iter(thumbnails(given))
        except (ValueError, IndexError, KeyError, struct.error) as e:
            if len(raw) > 1:
                half = len(raw) // 2
                return rows_of(raw[:half]) + rows_of(raw[half:])
            return [(None,) * (len(names) - 1) + (f"{type(e).__name__}: {e}",)]
        return [row(m, next(seen)) if m is not None else (None,) * len(names) for m in raw]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                raw = b.column(1).to_pylist()
                rows = rows_of(raw)
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, *names])

    schema = T.StructType([T.StructField(id_col, _like(media, id_col)), *T._parse_datatype_string(", ".join(fields)).fields])
    return media.select(id_col, "media").mapInArrow(trimmed(run), schema)
