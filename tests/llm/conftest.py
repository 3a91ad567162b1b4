import pytest
from pyspark.sql import functions as F

KINDS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the quick brown fox jumps over a lazy dog while many other small animals watch from behind tall green trees near water".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(WORDS[i * i % 20] + str(i % 97) for i in range(40_000)) + "\n" + "x" * 50_000
    rows = [
        (1, "A line that is long enough\nAnother line of the text", "en", "a", 1),
        (2, "a LINE that is long enough  \nsomething else here", "en", "a", 2),
        (2, "a LINE that is long enough  \nsomething else here", "en", "a", 2),
        (None, "a line that is long enough\nno id here at all", None, None, None),
        (3, None, None, "b", None), (4, "", "de", None, 0), (5, " \t\n", "de", "b", 3), (6, long, "en", "a", 9), (7, long, "en", "b", 9), (8, "ß É 日本 🙂", "xx", "ü", 5),
    ]
    df = spark.createDataFrame(rows, KINDS)
    for name in ("size", "shard", "key", "n", "rank", "_rid", "print", "base", "start", "payload", "target", "kept"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
