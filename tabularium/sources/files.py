"""Readers of files and folders. Every cell is text, trimmed; types come with preparation."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabularium.functions.numbers import text
from tabularium.functions.text import extension
from tabularium.sources.formats import TRAINABLE, catalogue_table, sniff

SAMPLE_BYTES, MAX_FILES, MAX_LINE, MAX_COLUMNS = 64 << 10, 100_000, 2 << 20, 100_000
DELIMITERS = ",;\t|"
#: Limits of NPZ archives: entries, unpacked bytes, packing ratio. Fixed values.
NPZ_ENTRIES, NPZ_BYTES, NPZ_RATIO = 16, 2 << 30, 200


class SourceError(ValueError):
    """A file that can't be read as what it should be."""


def encoding_of(sample: bytes, final: bool = False) -> str:
    """utf-8-sig, utf-16, utf-8, cp1251 or latin-1: the first that decodes a file's first bytes."""
    if sample.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    if sample.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    for name in ("utf-8", "cp1251"):
        try:
            # A character that the sample's end cuts is no error.
            codecs.getincrementaldecoder(name)().decode(sample, final)
            return name
        except UnicodeDecodeError:
            continue
    return "latin-1"


def delimiter_of(sample: str, suffix: str = ".csv") -> str:
    """The candidate that all of the first lines have equally often, and most often."""
    lines = [re.sub(r'"(?:[^"]|"")*"', "", x) for x in sample.splitlines()[:20] if x.strip()][: 20 if len(sample) < SAMPLE_BYTES else 19]
    best = (0, "")
    for d in DELIMITERS:
        counts = {x.count(d) for x in lines}
        if len(counts) == 1 and (n := counts.pop()) > best[0]:
            best = (n, d)
    return best[1] or ("\t" if suffix.lower() == ".tsv" else ",")


def _head(spark: SparkSession, path: str) -> tuple[bytes, int]:
    """A file's first bytes and its size; of a folder those of its first file by name. Paths need not be local."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise SourceError(f"{path} isn't a file")
    while (status := fs.getFileStatus(where)).isDirectory():
        inside = sorted((x.getPath() for x in fs.listStatus(where)), key=lambda p: p.getName())
        inside = [p for p in inside if p.getName()[0] not in "._"]
        if not inside:
            raise SourceError(f"{path} holds no file")
        where = inside[0]
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(SAMPLE_BYTES)), status.getLen()
    finally:
        stream.close()


def open_uri(uri: str):
    """A file of Spark's ``path`` column, opened for reading by ranges (file, hdfs, s3 and gs)."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _with_ends(files: DataFrame, first: int, last: int) -> DataFrame:
    """(path, length, head, tail): the first and last bytes of files (path, length), read by ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            heads, tails = [], []
            for uri in b["path"]:
                with open_uri(uri) as f:
                    heads.append(f.read_at(min(first, f.size()), 0))
                    tails.append(f.read_at(min(last, f.size()), max(0, f.size() - last)))
            yield b.assign(head=heads, tail=tails)

    return files.select("path", "length").mapInPandas(run, "path string, length long, head binary, tail binary")


@dataclass(frozen=True)
class Detected:
    encoding: str
    delimiter: str


def detect_text(spark: SparkSession, path: str) -> Detected:
    sample, size = _head(spark, path)
    name = encoding_of(sample, final=size <= SAMPLE_BYTES)
    return Detected(name, delimiter_of(codecs.getincrementaldecoder(name)("replace").decode(sample), "." + path.rpartition(".")[2]))


def _trimmed(df: DataFrame) -> DataFrame:
    return df.select(*(text(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns if c.strip()))


#: What the upper half of a byte table is in ISO-8859-1 and, where it has a character, in cp1251.
_UPPER = [(bytes([b]).decode("latin-1"), bytes([b]).decode("cp1251")) for b in range(128, 256) if b != 0x98]


def read_delimited(spark: SparkSession, path: str, found: Detected | None = None) -> DataFrame:
    """A file with a header line, of any size; quotes are doubled inside quotes, blank lines are skipped."""
    found = found or detect_text(spark, path)
    reader = spark.read.options(header=True, inferSchema=False, sep=found.delimiter, quote='"', escape='"')
    if found.encoding in ("utf-8", "utf-8-sig"):
        return _trimmed(reader.csv(path))
    if found.encoding == "utf-16":
        # Its line feeds aren't single bytes, so a file is one stream there.
        return _trimmed(reader.options(encoding="UTF-16", multiLine=True).csv(path))
    df = reader.option("encoding", "ISO-8859-1").csv(path)
    if found.encoding == "cp1251":  # byte by byte the same file; Spark has no decoder for it
        latin, cyrillic = ("".join(x) for x in zip(*_UPPER, strict=True))
        renamed = str.maketrans(latin, cyrillic)
        df = df.select(*(F.translate(F.col(f"`{c}`"), latin, cyrillic).alias(c.translate(renamed)) for c in df.columns))
    return _trimmed(df)


def read_jsonl(spark: SparkSession, path: str, flat: bool = False) -> DataFrame:
    """One object a line, blank lines skipped; every value as text, zeros stay zeros.

    The columns are the first line's keys, then those that only later lines have, by name.
    ``flat`` refuses lines above 2 MiB, nested values and keys that the first line lacks.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.select(F.json_object_keys("value")).first()
    if first is None or first[0] is None:
        raise SourceError(f"{path} holds no objects")
    columns = list(dict.fromkeys(first[0]))
    keys = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, columns)).cast("array<string>"))
    if flat:
        wrong = lines.select(F.max(F.octet_length("value")).alias("longest"), F.count_if(F.size(keys) > 0).alias("unknown")).first()
        if wrong.longest > MAX_LINE:
            raise SourceError("a line is longer than 2 MiB")
        if wrong.unknown:
            raise SourceError(f"{wrong.unknown} lines have fields that the first line lacks")
    else:
        later = lines.select(F.explode(keys).alias("k")).distinct().limit(MAX_COLUMNS + 1).collect()
        if len(later) > MAX_COLUMNS:
            raise SourceError(f"the lines have more than {MAX_COLUMNS} fields")
        columns += sorted(r.k for r in later)
    if not columns:
        raise SourceError(f"{path} holds no fields")
    bad = "__bad"
    while bad in columns:
        bad += "_"
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in (*columns, bad))
    rows = spark.read.schema(schema).options(columnNameOfCorruptRecord=bad, mode="PERMISSIVE").json(path)
    nested = F.lit(False)
    for c in columns:
        nested = nested | F.coalesce(F.col(f"`{c}`").rlike(r"^\s*[\[{].*[\]}]\s*$"), F.lit(False))
    wrong, deep = rows.select(F.count(bad), F.count_if(nested)).first()
    if wrong:
        raise SourceError(f"{wrong} lines aren't objects")
    if flat and deep:
        raise SourceError(f"{deep} lines have nested values")
    return _trimmed(rows.drop(bad))


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of lines that aren't objects, numbered from 1."""
    numbered = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n?|\n")).alias("at", "value"))
    return numbered.where((F.trim("value") != "") & F.json_object_keys("value").isNull()).select((F.col("at") + 1).alias("line"), "value")


def python_text(c: Column, kind: str) -> Column:
    """A typed cell as its text in Python: booleans and floats are written otherwise in Spark."""
    if kind == "boolean":
        return F.initcap(c.cast("string"))
    if kind in ("float", "double"):

        @F.pandas_udf("string")
        def shown(x: pd.Series) -> pd.Series:
            return x.map(lambda v: None if v is None or pd.isna(v) else str(float(v)))

        return shown(c)
    return c.cast("string")


def read_parquet(spark: SparkSession, path: str, as_text: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    return _trimmed(df.select(*(python_text(F.col(f"`{c}`"), k).alias(c) for c, k in df.dtypes))) if as_text else df


def inspect_parquet(spark: SparkSession, path: str, rows: int = 20) -> dict:
    """Rows, row groups and columns from the footers, and the first rows; the last column is the suggested target."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    df = spark.read.parquet(path)
    groups = total = 0
    for file in df.inputFiles():
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
        try:
            blocks = reader.getRowGroups()
            groups += blocks.size()
            total += reader.getRecordCount()
        finally:
            reader.close()
    return {"rows": total, "row_groups": groups, "columns": df.columns, "target": df.columns[-1], "preview": [r.asDict() for r in df.limit(rows).collect()]}


def read_numeric_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A typed scan of a CSV file of finite numbers; anything else in a column that is read fails the query."""
    header = spark.read.option("header", True).option("sep", delimiter).csv(path)
    columns = [c.strip() for c in header.columns if c.strip()]
    schema = ", ".join(f"`{c}` double" for c in columns)
    df = spark.read.schema(schema).options(header=True, sep=delimiter, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, quote="", enforceSchema=False).csv(path)
    def checked(c: str) -> Column:
        x = F.col(f"`{c}`")
        return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.raise_error(F.lit(f"{c} has a cell that isn't a finite number")).cast("double")).alias(c)

    return df.select(*map(checked, columns))


def load_npz(raw: bytes):
    """The arrays x (rows, features) and y (rows) of an archive, within the limits."""
    import numpy as np

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = z.infolist()
        if len(infos) > NPZ_ENTRIES:
            raise SourceError("the archive has too many arrays")
        if any(".." in i.filename or i.filename.startswith("/") for i in infos):
            raise SourceError("an array's name leaves the archive")
        if sum(i.file_size for i in infos) > NPZ_BYTES:
            raise SourceError("the arrays are too large")
        if any(i.file_size > NPZ_RATIO * max(1, i.compress_size) for i in infos):
            raise SourceError("an array is packed too densely")
    with np.load(io.BytesIO(raw), allow_pickle=False) as got:
        if not {"x", "y"} <= set(got.files):
            raise SourceError("the archive needs x and y")
        x, y = got["x"], got["y"]
    if x.ndim != 2 or y.ndim != 1 or len(x) != len(y):
        raise SourceError("x must be a matrix with a row for each value of y")
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise SourceError("a value isn't finite")
    return x.astype(float), y.astype(float)


class NpzSource(DataSource):
    """``spark.read.format("npz").load(path)``: rows (row_index, features, label) of local archives."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "row_index long, features array<double>, label double"

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(self.options["path"])


class NpzReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            x, y = load_npz(f.read())
        for k in range(len(x)):
            yield k, x[k].tolist(), float(y[k])


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """An archive's rows through ``binaryFile``, so that any path Spark knows will do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                x, y = load_npz(raw)
                for lo in range(0, len(x), 8192):
                    part = x[lo : lo + 8192]
                    yield pd.DataFrame({"row_index": range(lo, lo + len(part)), "features": part.tolist(), "label": y[lo : lo + 8192]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row_index long, features array<double>, label double")


READERS = {"delimited": read_delimited, "jsonl": read_jsonl, "parquet": read_parquet, "npz": read_npz}


def reader_for(path: str) -> str:
    kind = TRAINABLE.get(path.rpartition(".")[2].lower())
    if kind is None:
        raise SourceError(f"no reader takes {path}")
    return kind


def read(spark: SparkSession, path: str) -> DataFrame:
    return READERS[reader_for(path)](spark, path)


def folder_files(spark: SparkSession, path: str, limit: int = MAX_FILES) -> list[tuple[str, int]]:
    """(path, length) of the folder's trainable tables, by lower-case path. File names only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    wanted = files.where(F.lower("path").rlike(r"\.(csv|tsv|jsonl|ndjson|parquet|pq)$")).orderBy(F.lower("path"), "path").limit(limit + 1).collect()
    if len(wanted) > limit:
        raise SourceError(f"the folder has more than {limit} files")
    if not wanted:
        raise SourceError("the folder has no table")
    return [(r.path, r.length) for r in wanted]


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The union of a folder's tables in path order, with ``row_index`` over all of them.

    All must have the same columns in the same order. A file's rows are numbered in
    their order; files before it shift them by their counts.
    """
    out, base, columns = None, 0, None
    for file, _ in folder_files(spark, path):
        df = read(spark, file)
        if columns is not None and df.columns != columns:
            raise SourceError(f"{file} has other columns than the first file")
        columns = df.columns
        placed = with_file_order(df, base)
        base += df.count()
        out = placed if out is None else out.unionByName(placed)
    return out


def with_file_order(df: DataFrame, base: int = 0, name: str = "row_index") -> DataFrame:
    """Adds the place of each row of a one-file frame, counted on from ``base``.

    A row's partition and place in it come from the scan; partitions' sizes, a number
    per partition, shift them.
    """
    m = df.withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    sizes = {r[0]: r[1] for r in m.groupBy(part).count().collect()}
    offsets, total = {}, base
    for k in sorted(sizes):
        offsets[k] = total
        total += sizes[k]
    if not offsets:
        return m.withColumn(name, F.lit(None).cast("long")).drop("__m")
    table = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))
    return m.withColumn(name, (F.element_at(table, part) + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__m")


def inspect_folder(spark: SparkSession, path: str) -> DataFrame:
    """(format, category, modality, level, n, bytes): a folder's files by format."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(extension(F.col("path")).alias("extension"), "length")
    known = catalogue_table(spark)  # a few hundred rows, fixed
    got = files.join(F.broadcast(known), "extension", "left")
    return got.groupBy("extension", "category", "modality", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


def inspect_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, extension, sniffed) of files; only their first bytes are looked at."""
    files = _with_ends(spark.read.format("binaryFile").load(path), 64, 0)
    ext = extension(F.col("path"))
    return files.select("path", "length", ext.alias("extension"), sniff(F.col("head"), ext).alias("sniffed"))


def fingerprint(spark: SparkSession, path: str) -> str:
    """One digest of files' names, sizes and first and last MiB, in path order."""
    files = _with_ends(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), 1 << 20, 1 << 20)
    ends = F.sha2(F.concat("head", "tail"), 256)
    lines = files.select(F.concat_ws("|", "path", F.col("length").cast("string"), ends).alias("x"))
    return lines.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("x"))), 256)).first()[0]
