"""Small tables that hold the awkward cases every operator must define."""

import pytest

LONG = "lorem ipsum dolor " * 20000


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """NULL in any column, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [
        (1, "one two three four five", "en", "a", "x"), (1, "one two three four five", "en", "a", "x"),
        (None, "one two three four six", "en", None, None), (2, None, None, "a", "y"), (3, "", "en", "a", "z"),
        (4, " \n\t ", "en", "b", "z"), (5, LONG, "en", "b", None), (6, "Ünïcödé 中文 \x1c don't <|endoftext|> we'll 123", None, None, "w"),
        (7, "12345 --- !!!", "en", "a", "w"), (None, None, None, None, None), (8, "\x00\x0b a b ＡＢＣ ǅ ﬁ İ Σ", "de", "c", "v"),
    ]
    schema = ("doc_id long, text string, lang string, source string, ids string")
    frame = spark.createDataFrame(rows, schema)
    for clash in ("k0", "t", "row", "size", "score", "n_tokens", "fp", "rank", "entry"):
        from pyspark.sql import functions as F

        frame = frame.withColumn(clash, F.lit("own"))
    return frame.repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
