"""The catalogue of file formats: a small table, built from rules and parameters."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes whose files can be trained on, by reader. Fixed values.
TRAINABLE = {"csv": "delimited", "tsv": "delimited", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "pq": "parquet", "npz": "npz"}
#: Suffixes of text beside those that the system's type table calls text. A parameter.
TEXT_SUFFIXES = "txt text md rst tex log org adoc py pyi c h cc cpp hpp go rs java kt scala rb php pl lua r jl sql sh bash ps1 bat js ts jsx tsx vue swift dart json yaml yml toml ini cfg conf env xml html htm css psv srt vtt".split()
#: First bytes (hex) of formats that suffixes may hide. Fixed values.
MAGIC = (
    ("89504e47", "png"), ("ffd8ff", "jpeg"), ("47494638", "gif"), ("25504446", "pdf"), ("504b0304", "zip"), ("1f8b", "gzip"),
    ("50415231", "parquet"), ("41524f57", "arrow"), ("53514c69746520666f726d6174", "sqlite"), ("894844460d0a1a0a", "hdf5"), ("934e554d5059", "npy"),
)


def catalogue(extra: dict[str, tuple[str, str]] | None = None) -> list[tuple[str, str, str, str]]:
    """(extension, category, modality, level) rows, first entry of an extension wins.

    Levels: train, extract (text that can be read), recognize, inspect. Beside the
    trainable and text suffixes the rows come from the system's table of media types;
    ``extra`` maps further extensions to (category, level).
    """
    rows: dict[str, tuple[str, str, str, str]] = {}

    def put(ext: str, category: str, modality: str, level: str) -> None:
        rows.setdefault(ext, (ext, category, modality, level))

    for s, reader in TRAINABLE.items():
        put("." + s, reader, "table", "train")
    for s in TEXT_SUFFIXES:
        put("." + s, "text", "text", "extract")
    for ext, (category, level) in (extra or {}).items():
        put(ext, category, category, level)
    table = mimetypes.MimeTypes(())  # the module's own table, not that of the machine
    for strict in (True, False):
        for ext, kind in sorted(table.types_map[strict].items()):
            top = kind.partition("/")[0]
            level = "extract" if top == "text" else "recognize" if top in ("image", "audio", "video", "font") else "inspect"
            put(ext.lower(), top, top, level)
    return list(rows.values())


def catalogue_table(spark: SparkSession, extra: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(catalogue(extra), "extension string, category string, modality string, level string")


def format_counts(formats: DataFrame) -> DataFrame:
    return formats.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def sniff(content: Column, extension: Column | None = None) -> Column:
    """The format that a file's first bytes show, else the one of its extension, else unknown."""
    head = F.lower(F.hex(F.substring(content, 1, 16)))
    out = F
    for magic, name in MAGIC:
        out = out.when(F.startswith(head, F.lit(magic)), F.lit(name))
    rest = F.when(extension != "", F.substring(extension, 2, 64)).otherwise(F.lit("unknown")) if extension is not None else F.lit("unknown")
    return out.otherwise(rest)
