import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import simhash


def mark(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    each = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in each) > len(each))


def groups(marks):
    """Least index that is reachable over links, by trying all pairs."""
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(marks)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(marks))]


def test_query_equals_brute_force(spark, small, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash(spark, small).collect()}
    marks = [mark(t) for _, t in docs]
    roots = groups(marks)
    assert got == {docs[n][0]: (f"{marks[n]:016x}", docs[roots[n]][0]) for n in range(len(docs))}


@pytest.mark.parametrize(("spread", "long"), [(64, 4096), (64, 3), (12, 4096), (20, 100)])
def test_links_of_given_fingerprints(spark, spread, long):
    """Chains, balls and noise; with few varied bits posting lists grow long."""
    rng = random.Random(spread)
    marks = {rng.getrandbits(64) for _ in range(50)}
    base = rng.getrandbits(64)
    marks |= {base ^ sum(1 << rng.randrange(spread) for _ in range(rng.randint(0, 6))) & (1 << 64) - 1 for _ in range(500)}
    chain = base
    for _ in range(40):
        chain ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        marks.add(chain)
    marks = sorted(marks)
    signed = np.array(marks, dtype=np.uint64).view(np.int64).tolist()
    roots = simhash.components(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), long))
    found = {r.node: r.root for r in roots.collect()}
    expected = groups(marks)
    name = {}
    for n, x in enumerate(signed):
        assert name.setdefault(expected[n], found.get(x, x)) == found.get(x, x)
    assert len(set(name.values())) == len(set(expected))


def test_every_pair_of_two_bits_meets_in_a_list():
    for a in range(64):
        for b in range(a, 64):
            off = {7 - a // 8, 7 - b // 8}
            lists = [k for k, four in enumerate(simhash.FOUR) if not off & set(four)]
            assert lists and all(any(not off & set(six) for six in simhash.SIX[k]) for k in lists)


def test_long_lists_equal_short_ones():
    fp = np.unique(np.random.default_rng(1).integers(0, 1 << 11, 900, dtype=np.uint64)) << np.uint64(7)
    group = np.zeros(len(fp), dtype=np.int64)
    a, b = simhash.list_links(fp, group)
    expected = groups(fp.tolist())
    own = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert [own.get(x, x) for x in fp.tolist()] == [int(fp[k]) for k in expected]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 2000 + i) for i in range(500)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {2000 + i: 1000 for i in range(500)}


def test_odd_rows(spark, odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == 1
    assert by[3].fp == by[4].fp == by[5].fp == 0 and by[5].component_id == 3
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 6, 7, 8]
