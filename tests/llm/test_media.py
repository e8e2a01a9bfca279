import hashlib
import zlib

import numpy as np
import pytest

from tabularium.llm import jpeg_media as J


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_payloads_are_read_back(request, which):
    df = request.getfixturevalue(which)
    got = sorted((tuple(r)[3:7] + (r.doc_id, r.media_bytes) for r in J.read_media(J.to_media(df)).collect()), key=str)
    want, sizes = [], {}
    for r in df.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        p = J.pad(raw)
        want.append((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), r.doc_id, len(J.encode_media([raw])[0])))
        sizes[r.doc_id] = len(p)
    assert got == sorted(want, key=str)
    assert all(n > 0 and n % 192 == 0 for n in sizes.values())


def test_empty_table_and_null_media(spark, no_docs):
    assert J.read_media(J.to_media(no_docs)).count() == 0
    rows = J.read_media(spark.createDataFrame([(1, None)], "doc_id long, media binary")).collect()
    assert rows[0].payload_bytes is None


@pytest.mark.parametrize("payload", [b"", b"x", b"\xff" * 5000, bytes(range(256)) * 9, b"\x00\xff" * 3000, bytes(np.random.default_rng(3).integers(0, 256, 40_000, dtype=np.uint8))])
def test_any_bytes(payload):
    media = J.encode_media([payload])[0]
    luma, width, height, note = J.thumbnails([media])[0]
    assert luma.tobytes() == J.pad(payload) and note == b"n_bytes=%d" % len(payload)
    im = J.parse(media)
    assert (im.width, im.height) == (width, height) == (1536, 8 * len(luma))
    assert (J.decode_any(im, J.split_scan(im)) == luma.astype(int) - 128).all()


def test_payload_of_several_images(monkeypatch):
    monkeypatch.setattr(J, "MAX_ROWS", 3)
    payload = bytes(np.random.default_rng(4).integers(0, 256, 192 * 10 - 5, dtype=np.uint8))
    media = J.encode_media([payload, b"second"])
    assert media[0].count(b"\xff\xd8\xff") == 4
    got = J.thumbnails(media)
    assert got[0][0].tobytes() == J.pad(payload) and got[1][0].tobytes() == J.pad(b"second")


class Bits:
    """A writer of scan data, for images that to_media doesn't make."""

    def __init__(self):
        self.bits = ""

    def put(self, table, symbol, value=None, size=0):
        code, n = table[symbol]
        self.bits += format(code, f"0{n}b")
        if size:
            self.bits += format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b")

    def data(self):
        raw = self.bits + "1" * (-len(self.bits) % 8)
        return int(raw, 2).to_bytes(len(raw) // 8, "big").replace(b"\xff", b"\xff\x00")


def test_colour_image_with_ac_coefficients():
    """Three components, luminance sampled twice as densely, AC runs, no restarts."""
    dc_codes, ac_codes = ((), (0, 1, 2), (3,), (4,), (5,), (6,), (7,)), ((), (0x00, 0x01), (0x12,), (0xF0, 0x05))
    dc, ac = J.canonical(dc_codes), J.canonical(ac_codes)
    rng = np.random.default_rng(6)
    luma = rng.integers(-60, 60, (4, 6))
    w, pred = Bits(), {1: 0, 2: 0, 3: 0}

    def block(c, value):
        d = int(value) - pred[c]
        pred[c] = int(value)
        s = abs(d).bit_length()
        w.put(dc, s, d, s)
        w.put(ac, 0x01, 1, 1)
        w.put(ac, 0xF0)
        w.put(ac, 0x12, -3, 2)
        w.put(ac, 0x00)

    for my in range(2):
        for mx in range(3):
            for v in range(2):
                for h in range(2):
                    block(1, luma[2 * my + v, 2 * mx + h])
            block(2, 7)
            block(3, -9)
    quant = J._segment(0xDB, bytes([0, 16] + [1] * 63))
    frame = J._segment(0xC0, bytes([8, 0, 30, 0, 45, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    scan = J._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    media = b"\xff\xd8" + J._segment(0xE0, b"JFIF\0") + quant + frame + J._table(0, dc_codes) + J._table(1, ac_codes) + scan + w.data() + b"\xff\xd9"
    got, width, height, _ = J.thumbnails([media])[0]
    assert (width, height) == (45, 30)
    assert (got == np.clip((luma * 16 + 4) // 8 + 128, 0, 255)).all()


def test_hash_and_faults():
    flat = np.full((40, 192), 9, np.uint8)
    ramp = np.tile(np.arange(192, dtype=np.uint8), (3, 1))
    assert J.thumbnail_hash(flat) == "0" * 16 and J.thumbnail_hash(ramp) == "f" * 16
    media = J.encode_media([b"abc"])[0]
    for bad in (b"", media[:-2], b"\x89PNG" + media, media.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises((ValueError, IndexError)):
            J.thumbnails([bad])[0]


def test_stored_media_and_faulty_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "some text"), (2, None), (3, "x" * 1000)], "doc_id long, text string")
    stored = J.store_media(df, uri=f"file://{tmp_path}/media")
    good = {r.doc_id: r for r in J.read_media(stored).collect()}
    assert {k: r.n_bytes for k, r in good.items()} == {1: 9, 2: 0, 3: 1000} and all(r.error is None for r in good.values())
    rows = [(r.doc_id, bytes(r.media)) for r in stored.collect()] + [(4, b""), (5, b"no image"), (6, None)]
    mixed = {r.doc_id: r for r in J.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert all(mixed[k] == good[k] for k in good)
    assert all(mixed[k].error and mixed[k].payload_sha256 is None for k in (4, 5))
    assert mixed[6].error is None and mixed[6].media_bytes is None
