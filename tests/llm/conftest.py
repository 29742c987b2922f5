import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("kept", "component_id", "key", "rep", "members", "run", "host", "path", "found", "r_id", "r_hash", "__row_id", "__row_hash", "__of_id")]
)


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names clash with the operators' own."""

    def build(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, *["x"] * 14) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(3)

    return build


#: Nulls, empty and blank texts, repeated rows, a very long line and characters of every width.
ODD = [None, "", " \n\t", "a b", "a b", "x " * 60_000, "é ß 𝒳\x00\x0b", "A B C D E F", "a b c d e f", "a\n\n\nb"]
