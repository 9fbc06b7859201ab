"""Small tables with nulls, empty and long texts, copies and clashing columns."""

import pytest

from lodestone.llm import common


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    common.ship(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every oddity, and columns whose names the operators use themselves."""
    words = [f"w{i % 97}x{i % 13}" for i in range(30_000)]
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, None),
        (4, "One short text.", "en", ""),
        (5, "One short text.", "en", "b"),
        (6, " ".join(words), "en", "b"),
        (7, "ähnlich schöne Größe " * 50, "de", "b"),
        (8, "x" * 5_000, "de", "b"),
        (9, "日本語 😀 text\x1fodd", None, "c"),
        (None, "a text without an id and some words in it", "en", "c"),
        (11, "call +1 (301) 555-0346 or mail a.b@c.example.com now", "en", "c"),
    ]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.lit(7).alias("key"), F.lit("z").alias("fp"), F.lit(1).alias("n"), F.lit("q").alias("u"), F.lit(0).alias("cell"), F.lit("t").alias("ids"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
