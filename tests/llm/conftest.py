import pytest
from pyspark.sql import functions as F

LONG = "word another thing here now again. " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Null, empty, blank, very long, tied and repeated rows."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, LONG, "en", "b", len(LONG)), (5, "A", "de", None, 1),
        (6, "same text of seven words in all", "en", "c", 31), (6, "same text of seven words in all", "en", "c", 31),
        (7, "same text of seven words in all", "fr", "c", 31), (None, "no id but words", "en", "b", 15), (None, None, None, None, None),
        (8, "12 34 !! $$ --", "es", "d", -1), (9, "x" * 200_000, "en", "e", 200_000), (10, "Ünïcödé \U0001f642 漢字 Σίσυφος", "el", "e", None),
    ]
    rows += [(100 + k, f"the quick brown fox number {k % 7} jumps over the lazy dog and runs home to sleep. " * (1 + k % 3), "en", "abc"[k % 3], 80)
             for k in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The rows with further columns whose names operators might use themselves."""
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for c in ("row", "score", "size", "copies", "_k", "_salt", "node", "part", "rank", "shard", "words", "label"):
        df = df.withColumn(c, F.lit("mine"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
