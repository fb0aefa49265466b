import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

ODD = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for themselves
    *[T.StructField(c, T.StringType()) for c in ("size", "fp", "bucket", "copies", "score", "h", "_id", "_gone", "_copy", "length")]])
EXTRA = ["x"] * 10
LONG = " ".join(f"word{i % 997} tail{i % 13}" for i in range(60_000))


def odd_rows():
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [(1, "the cat sat on the mat and then the cat slept on the warm mat"), (2, None), (3, ""), (4, "   \t\n "),
             (5, LONG), (6, "the cat sat on the mat and then the cat slept on the warm mat"), (7, "x"),
             (7, "x"), (8, "naïve café – ünïcode 漢字 😀   done"), (9, f"one start {passage} end one"),
             (10, f"other start {passage} other end"), (None, "a row without an id"), (None, None)]
    return [(i, t, None if i == 5 else "en", None if i in (3, 8) else f"s{(i or 0) % 3}", len(t or ""), *EXTRA) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
