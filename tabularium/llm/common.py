"""What the corpus operators share: tables, the shared folder, row locators and byte stores."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of a local session without a setting of its own.
_own_root: list[str] = []
#: A byte table that lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows of a batch between the JVM and Python at most.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, which driver and executors share.

    Only a session without that setting (a local test) gets a folder of its own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_root:
            _own_root.append("file://" + tempfile.mkdtemp(prefix="tabularium-"))
        root = _own_root[0]
    elif ":" not in root.split("/")[0]:  # a path of the cluster's default file system
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root.removeprefix("file:")
    return f"{root.rstrip('/')}/tabularium/{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows; a lower setting stays.

    Spark counts a batch's rows, not its bytes: at its default of 10,000 an executor holds
    whole partitions of texts outside the heap, and again while their buffers grow.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a frame to the shared folder and reads it again: its lineage ends there."""
    small_batches(df.sparkSession)
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def located(df: DataFrame, file_col: str = "__file", row_col: str = "__row") -> DataFrame:
    """Adds a locator of each row (hash of its file's path, row in the file).

    It depends on the files alone, not on how a scan is cut into tasks, so two scans
    give a row the same locator even when executors came or went in between. A frame
    that isn't a plain Parquet scan is written to the shared folder first.
    """
    from pyspark.errors import AnalysisException

    def placed(frame: DataFrame) -> DataFrame:
        about = frame.metadataColumn("_metadata")  # also where a column has that name
        return frame.select("*", F.xxhash64(about["file_path"]).alias(file_col), about["row_index"].alias(row_col))

    try:
        out = placed(df)
        out.schema  # noqa: B018  resolves the columns
        return out
    except AnalysisException:
        return placed(materialize(df))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column's values as UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 1024):
    """``f`` for mapInArrow, kept small: it gets slices of ``rows`` rows (0: whole batches),
    and unused memory goes back to the system when a task ends.

    Spark keeps Python workers for later tasks; without this each of them keeps the
    largest amount that any of its tasks has used.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not rows:
                yield b
            else:
                for lo in range(0, b.num_rows, rows):
                    yield b.slice(lo, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(slices(batches))
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def file_system(uri: str):
    """The pyarrow file system and the path in it for a URI of the shared folder.

    ``pyarrow.fs`` knows file, hdfs, s3 and gs; executors use it for byte ranges,
    which no Spark reader offers.
    """
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
