import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import toxicity
from tessella.llm.common import table


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    sizes, trans = np.array([3, 0, 1, 7, 4, 9]), rng.normal(size=(2, 2))
    emit = rng.normal(size=sizes.sum()) * 2
    got, _ = toxicity.marginals(emit, sizes, trans)
    at = 0
    for n in sizes:
        e, whole, on = emit[at : at + n], 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            v = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
            whole, on = whole + v, on + v * np.array(y)
        assert n == 0 or np.allclose(on / whole, got[at : at + n])
        at += n


def test_long_sequences_agree_with_lanes():
    """Many lanes and one lane give the same."""
    rng = np.random.default_rng(1)
    emit, sizes, trans = rng.normal(size=5000) * 3, np.array([4000, 1, 999]), rng.normal(size=(2, 2))
    many, _ = toxicity.marginals(emit, sizes, trans)
    lanes, toxicity.LANES = toxicity.LANES, 1
    try:
        one, _ = toxicity.marginals(emit, sizes, trans)
    finally:
        toxicity.LANES = lanes
    assert np.allclose(many, one)


def corpus(n=400, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    texts, toxic = [], []
    for k in range(n):
        w = rng.choice(words, rng.integers(5, 80)).tolist()
        if k % 8 == 0:
            w[rng.integers(len(w))] = ["idiot", "Moron!", "blightful", "blighting"][k // 8 % 4]
        texts.append(" ".join(w))
        toxic.append(int(k % 8 == 0))
    return texts, toxic


def test_learns_words_and_beginnings():
    field = toxicity.fit(*corpus())
    score, found = toxicity._score(["w1 w2 idiot w3", "w1 w2 w3", "blightish w4", "", "w5 " * 500], field, {}, True)
    assert score[0] >= 0.7 and score[1] < 0.3 and score[2] >= 0.7 and score[3] < 0.3 and score[4] < 0.3
    assert [(x["start"], x["end"]) for x in found[0]] == [(6, 11)] and found[1] == []


def test_held_out(spark, small):
    got = toxicity.op10_toxicity(spark, small)
    rows = got.collect()
    assert {r.doc_id: r.held_out for r in rows} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_accuracy_of_the_larger_table(spark, small):
    larger = small.replace("sf0.001", "sf0.1")
    both = toxicity.op10_toxicity(spark, larger).where("held_out").join(table(spark, larger, "labels"), "doc_id")
    c = {(r.toxic, r.predicted): r["count"] for r in both.groupBy("toxic", "predicted").count().collect()}
    assert c[(1, 1)] >= 0.75 * (c[(1, 1)] + c.get((1, 0), 0)) and c.get((0, 1), 0) <= 0.01 * c[(0, 0)]


def test_only_permitted_rows_are_learned_from(spark):
    texts, toxic = corpus(60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(0, 0), (1, None)], "doc_id long, toxic int")
    got, kinds = toxicity.training_sample(docs, labels.where("doc_id % 2 = 0"))
    assert set(got) <= {texts[i] for i in range(0, 60, 2)} and sum(kinds) == sum(toxic[::2])


def test_one_text_of_each_doc_id_is_learned_from(spark):
    docs = spark.createDataFrame([(1, f"text {k:03d}") for k in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.training_sample(docs, labels) == (["other", "text 000"], [0, 1])


def test_odd_rows(spark, odd, nothing):
    field = toxicity.fit(*corpus(120))
    got = {r.doc_id: r for r in toxicity.score(odd, field).collect()}
    assert got[3].score == got[4].score == got[5].score < 0.7
    assert toxicity.score(nothing, field).count() == 0
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.fit([], []) is None and toxicity.fit(["a"], [1]) is None
    kept = toxicity.score(odd, field, keep=tuple(odd.columns), offsets=False, out="__score").drop("__score")
    assert kept.columns == odd.columns
