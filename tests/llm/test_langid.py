import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import langid
from tessella.llm.common import table


def test_phrases_are_longest_matches():
    sample = "abracadabra"
    step = langid.suffix_automaton(sample)
    inside = {sample[i:j] for i in range(len(sample)) for j in range(i, len(sample) + 1)}

    def plain(word):
        n = 0
        while word:
            k = max((k for k in range(1, len(word) + 1) if word[:k] in inside), default=1)
            word, n = word[k:], n + 1
        return n

    for word in ("abra", "cad", "zab", "zz", "abcabr", "dabrac", "bz", "rrr", "azbzc", "x"):
        assert langid.phrases(word, step) == plain(word), word


def test_held_out_accuracy(spark, small):
    got = langid.op8_language(spark, small)
    docs = table(spark, small, "documents")
    both = got.where("held_out").join(docs, "doc_id").where("lang is not null").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
    assert both.agg(F.avg("ok")).first()[0] >= 0.9
    rows = got.collect()
    assert {r.doc_id: r.held_out for r in rows} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd, nothing):
    samples = {"aa": " hello world ", "bb": " bonjour monde "}
    got = {r.doc_id: r for r in langid.identify(odd.withColumn("text", F.when(F.col("doc_id") == 8, F.lit("12 34 !!")).otherwise(F.col("text"))), samples).collect()}
    assert {got[i].lang_pred for i in (3, 4, 5, 8)} == {"und"} and got[3].score == 0.0
    assert got[6].lang_pred in samples
    assert langid.identify(nothing, samples).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.training_sample(nothing) == {}
    assert set(langid.training_sample(odd)) <= {"en", "de", "fr", "es"}


def test_sample_takes_whole_texts(spark):
    rows = [(1, f"text number {'abcdefgh'[i % 8] * (i % 50 + 1)} ends{i}", "en") for i in range(500)] + [(1, "the same", "de")] * 300 + [(2, "word " * 5000, "fr"), (3, "ok", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_sample(docs, rows=40, chars=2_000)
    assert got["de"] == " the same " and got["fr"] == " ok "
    assert 800 < len(got["en"]) <= 2_000
    whole = {langid.letters_of(t).strip() for _, t, g in rows if g == "en"}
    assert all(part.strip() in {w.removeprefix("text number").strip() for w in whole} for part in got["en"].split("text number") if part.strip())


def test_phrases_cross_words():
    step = langid.suffix_automaton(" good morning to you all ")
    assert langid.phrases(" good morning to ", step) == 1 and langid.phrases(" morning good ", step) > 1


def test_result_equals_brute_force():
    """Predictions by longest matches that are searched for in the labelled text itself."""
    rng = random.Random(3)
    samples = {g: " " + " ".join("".join(rng.choices(a, k=rng.randint(1, 6))) for _ in range(60)) + " " for g, a in (("x", "abcd"), ("y", "cdef"))}
    texts = [" ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def cost(t, sample):
        n, t = 0, langid.letters_of(t)
        while t:
            k = max((k for k in range(1, len(t) + 1) if t[:k] in sample), default=1)
            n, t = n + 1, t[k:]
        return n * np.log2(2 + len(sample))

    expected = [min(sorted(samples), key=lambda g: cost(t, samples[g])) for t in texts]
    assert langid.Parser(samples).predict(texts)[0] == expected


def test_ties_go_by_name():
    langs, scores = langid.Parser({"b": " x y ", "a": " x y "}).predict(["x", None, "1"])
    assert langs == ["a", "und", "und"] and scores == [0.5, 0.0, 0.0]


def test_no_language_is_lost(spark):
    """A language of few different texts among very many rows, one of long texts only, and more languages than a hundred."""
    from pyspark.sql import functions as F

    copies = spark.range(60_000).select(F.concat(F.lit("zq xj wq kx "), (F.col("id") % 5).cast("string"), F.lit(" qqz jjx")).alias("text"), F.lit("xx").alias("lang"))
    rows = [(f"the house and the tree number {i} of the street", "en") for i in range(300)] + [("vorba lunga " * 9000, "ro")]
    rows += [(f"{chr(97 + i % 26)}{chr(97 + i // 26)}o " * 20, f"l{i}") for i in range(120)]
    sample = langid.training_sample(copies.unionByName(spark.createDataFrame(rows, "text string, lang string")))
    assert {"xx", "en", "ro"} <= set(sample) and len(sample) == 123
    assert sample["ro"].split() == ["vorba", "lunga"] * 9000 and len(sample["en"]) <= 80_000
    assert langid.Parser({k: sample[k] for k in ("xx", "en", "ro")}).predict(["zq xj wq kx", "the street", "lunga vorba"])[0] == ["xx", "en", "ro"]


def test_states_lead_to_states():
    """Parsing goes from state to state without a table of numbers in between."""
    root = at = langid.suffix_automaton(" abc abd ")
    for c in " ab":
        at = at[c]
    assert set(at) == {"c", "d"} and set(root) == set(" abcd")


def test_hopeless_languages_are_left(monkeypatch):
    rng = random.Random(8)
    alphabets = ["abcdefg ", "fghijkl ", "klmnopq ", "pqrstuv ", "abcdefghijklmnopqrstuv "]
    samples = {f"l{k}": f" {''.join(rng.choices(a, k=2000))} " for k, a in enumerate(alphabets)}
    parser = langid.Parser(samples)
    texts = [langid.letters_of("".join(rng.choices(alphabets[k % 5] + alphabets[(k + 1) % 5], k=rng.choice([3, 250, 260, 3000])))) or " a " for k in range(60)]
    want = np.array([[langid.phrases(t, r) for r in parser.roots] for t in texts]) * parser.bits
    read, walk = [], langid.walk
    monkeypatch.setattr(langid, "walk", lambda t, *a: read.append(len(t)) or walk(t, *a))
    got = parser.costs(texts)
    assert np.array_equal(np.sort(got, axis=1)[:, :2], np.sort(want, axis=1)[:, :2]) and (got <= want).all()
    assert np.array_equal(got.argmin(axis=1), want.argmin(axis=1))
    assert sum(read) < 0.95 * 5 * sum(map(len, texts))
