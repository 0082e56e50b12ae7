import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, and columns of clashing names."""
    rng = random.Random(5)
    long_ = words(rng, 30_000)
    base = words(rng, 200)
    rows = [
        (1, base, "en", "a", None), (2, base, "en", "a", 5), (3, None, "en", "b", 1), (4, "", "de", "b", 0), (5, "  \n\t ", None, None, 3), (6, long_, "fr", "c", None),
        (7, base + " one more end", None, "a", 2), (None, base, "en", "a", 2), (None, None, None, None, None), (8, "short", "en", "é", 5), (8, "short", "en", "é", 5), (9, "日本語 text mit ümlaut 😀", "ja", "zz", 9), (10, "!!! ???", "en", "a", 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("id", "key", "nth", "score", "size", "copies", "curve", "shard", "rep", "comp", "spans", "html", "held_out", "gram", "of", "crc"):
        df = df.withColumn(name, F.lit(name))
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
