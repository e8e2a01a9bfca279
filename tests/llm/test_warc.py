import gzip
import hashlib
import re

import duckdb
import pytest

from tabularium.llm import warc as W
from tabularium.llm.common import file_system, shared_dir
from tabularium.llm.queries import ORACLE_SQL, QUERIES

LONG = "<p>" + "payload " * 30 + "</p>"
SCHEMA = "page_id long, url string, html string, key string"
ROWS = [
    (9, "http://B.example.com/x?q=1#f", LONG), (3, "https://www.example.org/a b", LONG), (3, "https://www.example.org/a b", LONG), (5, None, LONG), (4, "", "short"), (6, "http://e.com/\r\nX: y", "short"),
    (7, "http://e.com/n", None), (8, "http://e.com/n", ""), (None, "http://e.com/n", LONG + "other"), (None, "http://e.com/n", LONG + "other"), (10, "http://é.com/ü", "漢" * 100), (11, "nourl", "漢" * 100),
    (12, "http://e.com/big", "z" * 3_000_000), (13, "http://e.com/99", "9" * 99), (14, "http://e.com/99", "9" * 99), (15, "http://e.com/100", "0" * 100), (16, "http://e.com/100", "0" * 100),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def brute(rows):
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100:
            first.setdefault(raw, []).append(i)
    out, used = [], set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (h or "").encode()
        ids = first.get(raw, [])
        least = min((x for x in ids if x is not None), default=None)
        revisit = raw in used
        if len(raw) >= 100:
            used.add(raw)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    assert sorted((tuple(r) for r in W.round_trip(frame(spark)).collect()), key=str) == brute(ROWS)


def test_empty(spark):
    assert W.round_trip(frame(spark, [])).count() == 0


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    got = con.execute(ORACLE_SQL["op4_warc"])
    names = [d[0] for d in got.description]
    ours = QUERIES["op4_warc"](spark, "/root/testdata/sf0.01")
    assert sorted(tuple(r[n] for n in names) for r in ours.collect()) == sorted(got.fetchall())


def test_archives_are_gzip_members_of_warc_records(spark):
    folder = shared_dir(spark)
    captures = W.write_archives(frame(spark), folder).collect()
    assert len(captures) == len(ROWS)
    store, root = file_system(folder)
    for name in {c.segment for c in captures}:
        with store.open_input_stream(f"{root}/{name}", compression=None) as f:
            raw = f.read()
        plain = gzip.decompress(raw)
        own = [c for c in captures if c.segment == name]
        assert len(re.findall(rb"(?:^|\r\n\r\n)WARC/1.1\r\n", plain)) == len(own)
        assert sum(c.size for c in own) == len(raw)
        for c in own:
            head, http, body = W.parse_record(gzip.decompress(raw[c.offset : c.offset + c.size]))
            assert head["warc-type"] == c.type and head["warc-payload-digest"] == "sha256:" + c.digest
            assert "\r" not in head["warc-target-uri"]
            assert c.type == "revisit" or len(body) == int(http["content-length"])


def test_fetched_payloads_and_lookups(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 3)
    monkeypatch.setattr(W, "SEGMENT_BYTES", 2000)
    many = [(100 + k, f"http://h{k % 7}.com/p{k % 5}", f"<p>{k}" + "x" * 200) for k in range(200)]
    folder = shared_dir(spark)
    captures = W.write_archives(frame(spark, many).repartition(4), f"{folder}/a")
    shards = W.write_index(captures.repartition(3), f"{folder}/i")
    keys = spark.createDataFrame([("com,h3)/p2",), ("com,h3)/p2",), ("com,none)/",), ("a",), ("z",), (None,), ("com,h0)/p0",)], "key string")
    found = W.lookup(keys, shards, f"{folder}/i")
    want = {i for i, u, _ in many if u in ("http://h3.com/p2", "http://h0.com/p0")}
    assert {int(r.page) for r in found.collect()} == want
    got = W.fetch(found, f"{folder}/a").collect()
    html = {i: h.encode() for i, _, h in many}
    assert len(got) == len(want) and all(bytes(r.payload) == html[int(r.page)] for r in got)


def test_surt(spark):
    urls = [("https://www.Example.org/a?b#c", "org,example,www)/a?b"), ("http://h.com", "com,h)"), (None, ""), ("x y", "x%20y)")]
    df = spark.createDataFrame([(u,) for u, _ in urls], "u string")
    assert [r[0] for r in df.select(W.surt(df.u)).collect()] == [k for _, k in urls]


def test_damaged_payload_is_noticed(spark):
    folder = shared_dir(spark)
    captures = W.write_archives(frame(spark, ROWS[:1]), folder)
    c = captures.first()
    store, root = file_system(folder)
    head, _, _ = W.parse_record(gzip.decompress(store.open_input_file(f"{root}/{c.segment}").read()))
    bad = W._gzip(W.record("9", "http://x.com", b"y" * 200, head["warc-payload-digest"][7:], "<urn:uuid:0>", None))
    with store.open_output_stream(f"{root}/{c.segment}", compression=None) as f:
        f.write(bad)
    row = spark.createDataFrame([(c.key, c.page, c.segment, 0, len(bad), c.type, c.digest)], W.CAPTURE)
    with pytest.raises(Exception, match="differs from its header"):
        W.fetch(row, folder).collect()


def test_ids_of_any_text_come_back(spark):
    ids = ["a ", " a", "x\ty", "%20", "é\r\nb", ""]
    df = spark.createDataFrame([(i, f"http://a.org/{k}", "payload " * 20) for k, i in enumerate(ids)], "page_id string, url string, html string")
    rows = W.round_trip(df).collect()
    assert sorted(r.page_id for r in rows) == sorted(ids)
    assert {r.refers_to for r in rows} == {None, min(ids)}
