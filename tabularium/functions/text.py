"""Small text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def newline_norm(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def safe_name(c: Column) -> Column:
    """A file name without other characters than letters, digits, ``_``, ``.`` and ``-``."""
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")


def extension(path: Column) -> Column:
    """The last suffix of a path in lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def dataset_id(digest: Column, target: Column) -> Column:
    """``ds_`` and the first digits of the content's and the target's SHA-256."""
    return F.concat(F.lit("ds_"), F.substring(digest, 1, 12), F.lit("_"), F.substring(F.sha2(target, 256), 1, 4))


def config_hash(config: Column) -> Column:
    """SHA-256 of a struct's JSON; give its fields in sorted order."""
    return F.sha2(F.to_json(config), 256)


def payload_field(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")
