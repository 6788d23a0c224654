import pytest

from tessella.llm.common import table


@pytest.fixture(scope="session")
def docs(spark, small):
    """All documents of the smallest tables, as (doc_id, text)."""
    return [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").orderBy("doc_id").collect()]


#: Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with those that operators use.
ODD = [
    (1, "a b c d e", "en", "s0", 9),
    (1, "a b c d e", "en", "s0", 9),
    (2, "a b c d e", None, None, None),
    (3, None, "de", "s1", 0),
    (4, "", "de", "s1", 0),
    (5, " \n\t ", "de", None, 4),
    (None, "lonely words here", "fr", "s2", 17),
    (6, "x" * 100_000, "fr", "s2", 100_000),
    (7, "tok " * 30_000, "fr", "s2", 120_000),
    (8, "é😀 ß ﬀ   x", "es", "s3", 9),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("row", "size", "shard", "slot", "fp", "kept", "weight", "score", "topic", "label", "n", "start", "value", "text_", "media")})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
