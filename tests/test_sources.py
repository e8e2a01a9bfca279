import codecs
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.sources import extract, files, formats


def test_csv_with_quotes_blanks_and_semicolons(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('x;y;note\n 1 ;2;"a;b ""c"""\n\n3;;z\n')
    df = files.read(spark, str(p))
    assert files.detect_text(spark, str(p)).delimiter == ";"
    assert [tuple(r) for r in df.collect()] == [("1", "2", 'a;b "c"'), ("3", "", "z")]


def test_cp1251(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("имя,y\nКот,1\n".encode("cp1251"))
    assert [tuple(r) for r in files.read(spark, str(p)).collect()] == [("Кот", "1")]


def test_jsonl_keeps_zero_and_finds_faults(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"x": 0, "y": "a"}\n\n{"x": 1.5, "y": false}\n')
    assert [tuple(r) for r in files.read(spark, str(p)).collect()] == [("0", "a"), ("1.5", "false")]
    p.write_text('{"x": 1}\nnope\n')
    with pytest.raises(files.SourceError):
        files.read(spark, str(p))
    assert [r.line for r in files.bad_json_lines(spark, str(p)).collect()] == [2]
    p.write_text('{"x": 1}\n{"x": 2, "z": 1}\n')
    with pytest.raises(files.SourceError):
        files.read_jsonl(spark, str(p), flat=True)
    p.write_text('{"x": 1}\n{"x": [2]}\n')
    with pytest.raises(files.SourceError):
        files.read_jsonl(spark, str(p), flat=True)


def test_parquet_as_python_text(spark, tmp_path):
    p = str(tmp_path / "a.parquet")
    spark.createDataFrame([(1e7, True, 3), (1e-5, False, None)], "f double, b boolean, i int").coalesce(1).write.parquet(p)
    assert [tuple(r) for r in files.read(spark, p).collect()] == [("10000000.0", "True", "3"), ("1e-05", "False", "")]


def npz(path, **arrays):
    np.savez(path, **arrays)
    return str(path)


def test_npz_guards(spark, tmp_path):
    x, y = np.random.default_rng(0).normal(size=(40, 3)), np.arange(40.0)
    p = npz(tmp_path / "a.npz", x=x, y=y)
    rows = files.read(spark, p).orderBy("row_index").collect()
    assert len(rows) == 40 and rows[7].label == 7.0 and rows[7].features == pytest.approx(x[7].tolist())
    spark.dataSource.register(files.NpzSource)
    assert spark.read.format("npz").load(p).count() == 40
    load = lambda p: files.load_npz(open(p, "rb").read())  # noqa: E731, SIM115
    bad = x.copy()
    bad[3, 1] = np.nan
    for name, arrays in {"nan": {"x": bad, "y": y}, "no_y": {"x": x}, "many": {f"a{k}": y for k in range(17)}, "shape": {"x": x, "y": y[:5]}}.items():
        with pytest.raises(files.SourceError):
            load(npz(tmp_path / f"{name}.npz", **arrays))
    np.savez_compressed(tmp_path / "bomb.npz", x=np.zeros((100_000, 3)), y=np.zeros(100_000))
    with pytest.raises(files.SourceError):
        load(str(tmp_path / "bomb.npz"))
    with zipfile.ZipFile(tmp_path / "dots.npz", "w") as z:
        z.writestr("../x.npy", b"1")
    with pytest.raises(files.SourceError):
        load(str(tmp_path / "dots.npz"))


def test_folder_is_in_path_order(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x,y\n" + "".join(f"{k},1\n" for k in range(500)))
    (tmp_path / "A.csv").write_text("x,y\n-1,0\n-2,0\n")
    rows = files.read_folder(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [r.x for r in rows[:4]] == ["-1", "-2", "0", "1"] and [r.row_index for r in rows] == [*range(502)]
    counts = {r.extension: (r.n, r.level) for r in files.inspect_folder(spark, str(tmp_path)).collect()}
    assert counts == {".csv": (2, "train")}
    before = files.fingerprint(spark, str(tmp_path))
    (tmp_path / "A.csv").write_text("x,y\n-1,0\n-3,0\n")
    assert files.fingerprint(spark, str(tmp_path)) != before
    (tmp_path / "c.csv").write_text("y,x\n1,1\n")
    with pytest.raises(files.SourceError):
        files.read_folder(spark, str(tmp_path))


def test_sniff_goes_by_content(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "b.txt").write_bytes(b"plain")
    got = {r.path[-5:]: r.sniffed for r in files.inspect_file(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "png", "b.txt": "txt"}


def test_catalogue(spark):
    rows = formats.catalogue({".foo": ("model", "inspect")})
    assert len({r[0] for r in rows}) == len(rows) > 150
    assert {r.level: r.n for r in formats.format_counts(formats.catalogue_table(spark)).collect()}["train"] == 7


def test_text_extraction(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(codecs.BOM_UTF8 + b"x\r\ny\rz")
    (tmp_path / "b.md").write_bytes("Кот".encode("cp1251"))
    (tmp_path / "c.bin").write_bytes(b"\0\1")
    rows = {r.path[-5:].lstrip("/"): r for r in extract.extract_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == "x\ny\nz" and rows["a.txt"].encoding == "utf-8-sig"
    assert rows["b.md"].text == "Кот" and len(rows) == 2
    cut = extract.folder_budget(extract.extract_files(spark, str(tmp_path)), 6).orderBy("path").collect()
    assert [r.text for r in cut] == ["x\ny\nz", "К"]
    with pytest.raises(files.SourceError):
        list(extract.decode_chunks(b"a\0b", 1024, 100))
    assert [t for _, _, t in extract.decode_chunks(b"abcdef" * 1000, 1024, 1500)] == ["abcdef" * 170 + "abcd", ("abcdef" * 1000)[1024:1500]]


def test_chunks_and_budget_of_a_column(spark):
    df = spark.createDataFrame([(1, "a\r\nbcdef"), (2, ""), (3, None)], "k int, t string")
    got = [(r.k, r["index"], r.chunk) for r in extract.text_chunks(df, "k", "t", 4).orderBy("k", "index").collect()]
    assert got == [(1, 0, "a\nbc"), (1, 1, "def")]
    kept = extract.within_budget(spark.createDataFrame([(k, "abc") for k in range(5)], "k int, t string"), ["k"], "t", 7).orderBy("k").collect()
    assert [r.t for r in kept] == ["abc", "abc", "a"]


def test_python_text_of_json(spark, tmp_path):
    p = tmp_path / "a.ndjson"
    p.write_text("\n".join(json.dumps({"a": k, "b": str(k)}) for k in range(5)))
    assert files.read(spark, str(p)).agg(F.sum(F.col("a").cast("int"))).first()[0] == 10


def test_jsonl_keys_of_later_lines(spark, tmp_path):
    p = tmp_path / "late.jsonl"
    p.write_text('{"a":1}\n\n{"a":2,"c":"x","b":"late"}\n')
    df = files.read_jsonl(spark, str(p))
    assert df.columns == ["a", "b", "c"]
    assert sorted(tuple(r) for r in df.collect()) in ([("1", None, None), ("2", "late", "x")], [("1", "", ""), ("2", "late", "x")])


def test_other_encodings(spark, tmp_path):
    text = "имя;цвет\nАнна;красный\nИван;синий\n"
    for name, encoding in (("a.csv", "cp1251"), ("b.csv", "utf-16"), ("c.csv", "utf-8-sig")):
        (tmp_path / name).write_bytes(text.encode(encoding))
        df = files.read_delimited(spark, str(tmp_path / name))
        assert df.columns == ["имя", "цвет"]
        assert sorted(tuple(r) for r in df.collect()) == [("Анна", "красный"), ("Иван", "синий")]


def test_line_ends_at_a_border_and_long_files(tmp_path):
    raw = (b"x" * 1023 + b"\r\n") * 3 + b"end\r"
    got = [t for _, _, t in extract.decode_chunks(raw, 1024, 10_000)]
    assert "".join(got) == ("x" * 1023 + "\n") * 3 + "end\n"
    assert [t for _, _, t in extract.decode_chunks(b"", 1024, 10)] == []
