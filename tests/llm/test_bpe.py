import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from tessella.llm import bpe


def expected(t, text):
    ids = t.encode(text, add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def test_query_equals_library(spark, small, docs):
    t = Tokenizer.from_file(bpe.tokenizer_path())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op9_bpe(spark, small).collect()}
    assert got == {i: expected(t, x or "") for i, x in docs}


def test_random_texts():
    random.seed(4)
    path = bpe.tokenizer_path()
    t, m = Tokenizer.from_file(path), bpe.ByteBPE(path)
    bits = ["a", "b", " ", "\n", "'", "t", "é", "😀", "1", "_", "<|endoftext|>", "日本", "\0", "aaaa", "\x85", " ", "  ", "'ll", "́"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 60))) for _ in range(600)] + ["aaaaaaaaaaaaaaaaaaaaaaa", "", " ", "x" * 3000]
    for text, (joined, raw) in zip(texts, m.encode(texts), strict=True):
        ids = [int(i) for i in joined.split(",")] if joined else []
        theirs = t.encode(text, add_special_tokens=False).ids
        assert ids == theirs and m.decode(ids) == t.decode(theirs, skip_special_tokens=False) and raw == text.encode()


def test_odd_rows(spark, odd, nothing):
    t = Tokenizer.from_file(bpe.tokenizer_path())
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    got = bpe.encode_decode(odd, bpe.tokenizer_path(), ids=True).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(t, texts[r.doc_id])
        assert r.decoded == texts[r.doc_id] and len(r.token_ids) == r.n_tokens
    assert bpe.encode_decode(nothing, bpe.tokenizer_path()).count() == 0


def test_ranks_of_pairs():
    """Each merge has its rank, and no other pair has one."""
    m = bpe.ByteBPE(bpe.tokenizer_path())
    known = {int(k): int(r) for k, r in zip(m.keys, m.ranks, strict=True) if k >= 0}
    assert len(known) == len(m.merged)
    keys = np.array(list(known), dtype=np.int64)
    assert (m.rank(keys) == np.array(list(known.values()))).all()
    rng = np.random.default_rng(1)
    other = rng.integers(0, 60_000, 50_000) << 32 | rng.integers(0, 60_000, 50_000)
    assert m.rank(other).tolist() == [known.get(k, len(known)) for k in other.tolist()]


def test_ids_without_decoded_text(spark, odd):
    """The decoded text isn't carried to a caller who drops it; its digest is."""
    both = bpe.encode_decode(odd, bpe.tokenizer_path(), ids=True)
    ids = bpe.encode_decode(odd, bpe.tokenizer_path(), ids=True, back=False)
    assert ids.columns == [c for c in both.columns if c != "decoded"]
    assert sorted(map(str, ids.collect())) == sorted(map(str, both.drop("decoded").collect()))
