import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every awkward value, and columns whose names operators might use."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n\x0b\x0c\r ", "en", "a"),
        (5, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
        (5, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a"),
        (None, "THE quick brown fox jumps over the lazy dog near the old river bank today.", "de", "b"),
        (7, long, "en", "b"),
        (8, "naïve Ünïcode 漢字 emoji 😀 <|endoftext|> it's I'LL x \x1c y é İ K ſ", "fr", "b"),
        (9, "one two", "es", "c"),
        (10, "\n".join(["same line here"] * 30), "en", "c"),
        (11, "word " * 12, "en", "c"),
        (12, "Released under the MIT License.\nApache License, Version 2.0; CC BY-NC 4.0", "en", "c"),
        (13, "$%& ### *** <<< >>> | text with symbols and words in it", "en", "c"),
        (14, "\x00nul and �", "en", "c"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    clash = ["score", "fp", "block", "ids", "id", "media", "t", "key", "digest", "topic", "weight", "root", "words", "n_tokens", "_metadata", "file_path", "row_index",
             "__row", "__file", "file", "row", "__text", "__tokens", "__topic", "__source", "__lang", "__p", "__weight", "label", "u", "s", "i", "page"]
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(c) for c in clash))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
