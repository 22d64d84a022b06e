import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use themselves.
    *[T.StructField(n, T.StringType()) for n in (
        "id", "node", "version", "score", "n", "line", "row", "runs", "size", "sha", "label", "key", "path", "blob",
        "content", "component", "ids", "start", "items", "bits", "no", "__toxic", "toxic", "__id", "__version", "__dropped", "hash",
    )],
])


def docs_of(spark, pairs, lang="en"):
    extra = len(DOCS) - 5
    rows = [(i, t, lang, "s", None if t is None else len(t), *["x"] * extra) for i, t in pairs]
    return spark.createDataFrame(rows, DOCS).repartition(3, "doc_id")


def prose(seed, n, vocabulary=400):
    random.seed(seed)
    return " ".join(f"w{random.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = prose(1, 60_000)
    return [
        (1, "Some plain words. And more of them!\nA second line."), (2, None), (3, ""), (4, ""), (None, "Text without id"),
        (None, None), (5, long), (6, long), (7, "same row"), (7, "same row"), (8, " \t\n "), (9, "ünïcode ñ 日本語 🙂"),
        (10, "x" * 70_000), (11, "one"), (12, "...!?"),
    ]


@pytest.fixture
def odd(spark, odd_pairs):
    return docs_of(spark, odd_pairs)


@pytest.fixture
def none(spark):
    return docs_of(spark, [])


@pytest.fixture
def make(spark):
    return lambda pairs, **more: docs_of(spark, pairs, **more)
