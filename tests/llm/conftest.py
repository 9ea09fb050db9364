import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that operators use for columns of their own
    + [T.StructField(n, T.StringType()) for n in ("chunk", "key", "fingerprint", "component", "size", "position", "bucket", "digest", "score")]
)
EXTRA = ("x",) * 9

PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG = " ".join(f"w{i % 7919}q{i % 13}" for i in range(60_000))


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, shared passages, odd characters."""
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, None, 0),
        (3, " \t\n ", "en", None, 4),
        (4, "one two three", "en", "a", 13),
        (5, "one two three", "fr", "b", 13),
        (5, "one two three", "fr", "b", 13),
        (6, PASSAGE + " tail of six", "en", "a", 1),
        (7, "head of seven " + PASSAGE, None, "a", 1),
        (8, PASSAGE + "\n" + PASSAGE, "en", "b", None),
        (9, LONG, "en", "a", 1),
        (10, LONG.replace("w17q", "changed", 1), "en", "a", 1),
        (None, PASSAGE + " without id", "en", "a", 1),
        (None, None, None, None, None),
        (11, "1234 ... 5678", "en", "b", 1),
        (12, "été à l'école ñandú straße 世界 \U0001f600 x́y", "fr", "c", 1),
        (13, ("line of words here\n" * 30), "en", "c", 1),
        (14, ("line of words here\n" * 30), "en", "c", 1),
    ]
    return [r + EXTRA for r in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]
