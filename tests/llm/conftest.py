import pytest

NASTY = [
    (1, "same text of some length that goes on for a while, word by word", "en", "s", 10),
    (2, "same text of some length that goes on for a while, word by word", "en", "s", 10),
    (2, "same text of some length that goes on for a while, word by word", "en", "s", 10),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (5, " \t\n ", "en", "s", 4),
    (None, "a row without an id", "en", "s", 3),
    (6, "é ß 😀 日本 \x00 \x1c\x85 tab\tend", "de", "s", 5),
    (7, "long " * 60_000, "en", "s", 300_000),
    (8, "x" * 200_000, "en", "s", 200_000),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty, very long and repeated texts, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(NASTY, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("extra").alias(c) for c in ("fp", "key", "blob_id", "of", "path", "toxic", "ids", "media", "spans", "hash", "tokens", "__blob_")])


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
