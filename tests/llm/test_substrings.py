import hashlib
import random
import re
from collections import Counter

import numpy as np

from tessella.llm import substrings
from tessella.llm.substrings import op3_substrings, remove_repeats


def brute(rows, size=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[s : s + size]) for w in words for s in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if seen[tuple(w[s : s + size])] > 1:
                gone[s : s + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def result(df, **more):
    return sorted((tuple(r) for r in remove_repeats(df, **more).collect()), key=str)


def test_query_equals_brute_force(spark, small, docs):
    got = sorted(map(tuple, op3_substrings(spark, small).collect()))
    assert got == sorted((i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in brute(docs))


def test_random_texts(spark):
    """Few different words, shared passages, loops: all kinds of factors."""
    random.seed(7)
    pool = [[random.choice("abcdefgh") for _ in range(random.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(random.randint(0, 6)):
            w += random.choice(pool) if random.random() < 0.6 else [str(random.random())] * random.choice([1, 1, 50])
        rows.append((i, random.choice([" ", "\n", "\x0b "]).join(w)))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def plain_longest(lists, block, count):
    """Longest matches by comparing every two places of a block, word by word."""
    out = []
    for a, x in enumerate(lists):
        for s in range(len(x)):
            best = len(x) - s if count[a] > 1 else 0
            for b, y in enumerate(lists):
                if block[b] == block[a]:
                    for t in range(len(y)):
                        if (a, s) != (b, t):
                            k = 0
                            while s + k < len(x) and t + k < len(y) and x[s + k] == y[t + k]:
                                k += 1
                            best = max(best, k)
            out.append(best)
    return out


def test_factors_are_longest():
    rng = np.random.default_rng(9)
    for letters in (2, 3, 9):
        lists = [rng.integers(1, letters, rng.integers(1, 40)).astype(np.uint64) for _ in range(14)]
        block, count = rng.integers(0, 3, 14), rng.integers(1, 3, 14)
        sizes = np.array([len(x) for x in lists])
        of, ends = np.repeat(np.arange(14), sizes), np.cumsum(sizes)
        got = substrings.longest_matches(np.concatenate(lists), block[of], ends[of], count[of])
        expected = plain_longest(lists, block, count)
        assert got.tolist() == expected
        masks = substrings.duplicate_windows(lists, block, count, 4)
        for k, m in enumerate(masks):
            mine = expected[ends[k] - sizes[k] : ends[k]]
            assert m == sum(1 << i for i, n in enumerate(mine) if n >= 4)


def test_large_blocks_give_the_same(spark):
    """Blocks above and below the limit: the same spans by factors and by counting."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"a{i % 7} b{i % 5} " * 20 + passage + f" c{i % 3}" * 30) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, block=1) == result(df, block=5) == result(df) == brute(rows)


def test_small_windows(spark):
    rows = [(1, "a b c d"), (2, "x a b c"), (3, "a a a a a"), (4, "q")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), window=3, phrase=2) == brute(rows, 3)


def test_common_passage_with_different_surroundings(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"a{i} b{i} " * 20 + passage + f" c{i}" * 3) for i in range(400)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and all(r[2] >= 50 for r in got)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(odd) == brute(rows)
    assert remove_repeats(nothing).count() == 0
