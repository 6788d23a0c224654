import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import search
from tessella.operators.phraseindex import PhraseIndex, folded, positional


@pytest.fixture
def index(spark, tmp_path):
    return PhraseIndex(spark, f"file://{tmp_path}/phrases", buckets=8)


def docs(spark, *xs):
    return spark.createDataFrame(list(xs), "id long, text string")


def found(df):
    return sorted((r.id, r.tf, r.n_tokens) for r in df.collect())


def test_equals_a_scan(spark, index):
    """Random texts of few words: phrases of one to four words, repeated words and overlaps among them."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["on", "the", "ON", "a", "x,"]) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(900, None), (901, "")]
    df = docs(spark, *rows)
    index.add(df)
    for phrase in ["on", "on the", "the the", "on on the", "a x a on", "nowhere", "on nowhere"]:
        expected = [tuple(r) for r in search.phrase_bm25(df.fillna(""), phrase, 30).select("id", "tf", "n_tokens", "bm25", "rank").collect()]
        assert [tuple(r) for r in index.search(phrase, 30).select("id", "tf", "n_tokens", "bm25", "rank").collect()] == expected
    assert index.search(" .,", 5).count() == 0


def test_replaced_and_removed_documents(spark, index):
    index.add(docs(spark, (1, "red green blue"), (2, "green blue"), (3, "green blue green blue")))
    index.add(docs(spark, (2, "nothing here"), (4, "green  blue")))
    index.remove(spark.createDataFrame([(1,)], "id long"))
    expected = [(3, 2, 4), (4, 1, 2)]
    assert found(index.matches("green blue")) == expected
    index.compact()
    assert found(index.matches("green blue")) == expected and index.docs.read().select("run").distinct().count() == 1
    # a writer that died before its documents were committed
    index._write(docs(spark, (9, "x")).select(F.lit("green").alias("term"), "id", F.lit(1).alias("n_tokens"), F.array(F.lit(0)).alias("positions")))
    assert found(index.matches("green")) == [(3, 2, 4), (4, 1, 2)]


def test_diacritics_and_case_fold(spark, index):
    index.add(docs(spark, (1, "Crème BRÛLÉE"), (2, "creme brulee"), (3, "créme brûlée"), (4, "creme x brulee")))
    assert [r.id for r in index.search("crème Brulée", 9).orderBy("id").collect()] == [1, 2, 3]
    assert spark.range(1).select(folded(F.lit("ÀÉÎõüñçßŠž"))).first()[0] == "aeiouncßsz"


def test_search_reads_the_folders_of_its_terms_and_no_texts(spark, index):
    index.add(docs(spark, *[(i, f"word{i} word{i + 1} green blue") for i in range(50)]))
    plan = index.search("green blue", 5)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "Scan parquet" in x]
    assert any("PartitionFilters" in x and "bucket" in x.split("PartitionFilters")[1] for x in scans) and all("text" not in x.split("ReadSchema")[1] for x in scans if "ReadSchema" in x)


def test_hybrid_search_over_the_index(spark, index):
    rows = [(1, "python database helpers for web apps", "/src/api.py"), (2, "unrelated content", "/src/utils.py"), (3, "a python database", "/src/db.py")]
    d = spark.createDataFrame(rows, "id long, text string, path string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    index.add(d)
    a, b = (search.hybrid_search(d, v, "python database", [0.9, 0.1], **more).select("id", "score", "result_rank").collect() for more in ({}, {"index": index}))
    assert a == b and len(a) == 3


def test_lists_of_positions_need_no_shuffle(spark):
    df = positional(docs(spark, (1, "b a b  B, c"), (2, ""), (3, None), (4, "x")))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.id, r.term, r.n_tokens, r.positions) for r in df.collect())
    assert rows == [(1, "a", 5, [1]), (1, "b", 5, [0, 2, 3]), (1, "c", 5, [4]), (4, "x", 1, [0])]
