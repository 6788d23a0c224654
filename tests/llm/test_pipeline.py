import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_bpe import expected
from test_pii import base
from test_overlap import least, shingle_set
from tokenizers import Tokenizer

from tessella.llm import bpe
from tessella.llm.common import table
from tessella.llm.mixing import mix
from tessella.llm.toxicity import learn, score


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """What each stage returns, written and read again."""
    at, docs, out = tmp_path_factory.mktemp("stages"), table(spark, small, "documents"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, small).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs)
    return out


def test_columns(spark, small, stages):
    own = table(spark, small, "documents").dtypes
    assert all(s.dtypes == own for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "bpe"]


def test_toxic_go_and_clean_stay(spark, small, stages):
    docs = table(spark, small, "documents")
    bad = {r.doc_id for r in score(docs, learn(spark, small)).where("score >= 0.7").collect()}
    assert {r.doc_id for r in stages[0].collect()} == {r.doc_id for r in docs.collect()} - bad


def test_one_of_each_group(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[0].collect())
    roots = least([shingle_set(t) for _, t in rows])
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(rows[k][0] for k in set(roots))


def test_personal_data_is_gone(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    after = {r.doc_id: r for r in stages[2].collect()}
    assert set(before) == set(after)
    for i, t in before.items():
        spans = sorted((a, b, k) for k, found in base(t).items() for a, b in found)
        clean, at = "", 0
        for a, b, k in spans:
            if a >= at:
                clean += t[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert after[i].text == clean + t[at:] and after[i].n_chars == len(after[i].text)
    assert not any(re.search(r"\S@\S+\.\S", r.text) for r in after.values())


def test_mixing_keeps_what_it_draws(stages):
    kept = {r.doc_id for r in mix(stages[2]).where("kept").collect()}
    assert {r.doc_id for r in stages[3].collect()} == kept and kept


def test_encoding(stages):
    t = Tokenizer.from_file(bpe.tokenizer_path())
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    got = {r.doc_id: r for r in stages[4].collect()}
    assert set(got) == set(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(t, texts[i]) and len(r.token_ids) == r.n_tokens for i, r in got.items())


def test_run_equals_stages(spark, small, stages):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, small).collect()) == sorted(r.doc_id for r in stages[-1].collect())


def test_odd_rows(spark, small, odd, nothing):
    for df in (odd, nothing):
        docs = df
        for _, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, small)
            assert docs.columns == df.columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
        assert last.count() == docs.count()
