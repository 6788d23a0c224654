import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing
from tessella.llm.mixing import TEMPER, mix, op2_mixing, op2_sql, rake


def test_same_as_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].itertuples(index=False)))
    assert key(op2_mixing(spark, small).toPandas()) == key(con.execute(op2_sql()).df())


def test_margins_meet_targets(spark):
    cells = [(s, lang, t, (3 * i + 5 * j + 7 * k) % 11 + 1) for i, s in enumerate("abcde") for j, lang in enumerate(["en", "fr"]) for k, t in enumerate("xyz")]
    raked, gap = rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"))
    got = raked.collect()
    assert gap < 1e-9
    total = sum(c[3] for c in cells)
    for name in ("source", "lang", "topic"):
        now, was = defaultdict(float), defaultdict(float)
        for r in got:
            now[r[name]] += r.tokens * r.factor
            was[r[name]] += r.tokens / total
        goal = {k: v ** TEMPER[name] for k, v in was.items()}
        assert all(abs(now[k] - goal[k] / sum(goal.values())) < 1e-9 for k in goal)


def test_probabilities_make_up_the_share(spark, small):
    from tessella.llm.common import table

    got = mix(table(spark, small, "documents"), 0.5).agg(F.sum(F.col("n_tokens") * F.col("keep_prob")) / F.sum("n_tokens")).first()[0]
    assert abs(got - 0.5) < 1e-6


def test_one_source_of_most_rows_and_odd_rows(spark, odd, nothing):
    got = mix(odd).collect()
    assert len(got) == odd.count() and {r.kept for r in got} <= {True, False}
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert mix(nothing).count() == 0
    twins = [(r.kept, r.weight) for r in got if r.doc_id == 1]
    assert twins[0] == twins[1]
    own = mix(odd, topic=F.lit(None).cast("string"))
    assert {r.topic for r in own.collect()} == {""}


def by_hand(cells, goals, rounds):
    """Factors by raking in plain Python."""
    f = [1.0] * len(cells)
    for _ in range(rounds):
        for m, goal in enumerate(goals):
            now = defaultdict(float)
            for c, x in zip(cells, f, strict=True):
                now[c[m]] += c[3] * x
            f = [x * goal[c[m]] / now[c[m]] if now[c[m]] else 0.0 for c, x in zip(cells, f, strict=True)]
    now = defaultdict(float)
    for c, x in zip(cells, f, strict=True):
        now[c[0]] += c[3] * x
    return [x * goals[0][c[0]] / now[c[0]] for c, x in zip(cells, f, strict=True)]


@pytest.mark.parametrize("cells_a_task", [100_000, 4_000])
def test_many_topics_and_odd_names(spark, monkeypatch, cells_a_task):
    """30,000 topics, names that hold NUL or nothing; the same factors as by hand."""
    monkeypatch.setattr(mixing, "CELLS", cells_a_task)
    rng = random.Random(4)
    names = ["", "a\0b", "a", "\0"]
    cells = [(names[k % 4], names[k // 3 % 4], f"t\0{k}", rng.randint(1, 90)) for k in range(30_000)]
    cells += [(s, g, "all", 50) for s in names for g in names]
    raked, _ = rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), rounds=4)
    total, goals = sum(c[3] for c in cells), []
    for m, name in enumerate(TEMPER):
        was = defaultdict(float)
        for c in cells:
            was[c[m]] += c[3] / total
        goal = {k: v ** TEMPER[name] for k, v in was.items()}
        goals.append({k: v / sum(goal.values()) for k, v in goal.items()})
    expected = {c[:3]: x for c, x in zip(cells, by_hand(cells, goals, 4), strict=True)}
    got = {(r.source, r.lang, r.topic): r.factor for r in raked.collect()}
    assert set(got) == set(expected) and all(abs(got[k] - expected[k]) <= 1e-9 * expected[k] for k in got)


def test_targets_of_the_caller(spark):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 2], ["en", "fr"][i // 2 % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    table = spark.createDataFrame([("en", 3.0), ("fr", 1.0), ("nowhere", 9.0)], "lang string, share double")
    got = mix(df, targets={"source": {"a": 0.9, "b": 0.1}, "lang": table}, topic=F.lit("t")).collect()
    for name, goal in (("source", {"a": 0.9, "b": 0.1}), ("lang", {"en": 0.75, "fr": 0.25})):
        now = defaultdict(float)
        for r in got:
            now[r[name]] += r.weight
        assert all(abs(now[k] - v) < 1e-6 for k, v in goal.items())
    none = mix(df, targets={"source": {"a": 1.0}}, topic=F.lit("t")).where("source = 'b'").agg(F.max("keep_prob")).first()[0]
    assert none == 0


def test_targets_that_contradict_are_refused(spark):
    df = spark.createDataFrame([(1, "w", "a", "en"), (2, "w", "b", "fr")], "doc_id long, text string, source string, lang string")
    with pytest.raises(ValueError):
        mix(df, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "fr": 0.9}}, topic=F.lit("t"))
    with pytest.raises(ValueError):
        mix(df, targets={"sauce": {"a": 1.0}})
