import random
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tessella.llm import overlap
from tessella.llm.common import table


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def least(sets):
    """Least index that is reachable over links, by trying all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def near_copies():
    """Texts with a few words changed, from one below to one above the limit, and texts that share a line only."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    line, out = " ".join(rng.choices(words, k=12)), []
    for _ in range(12):
        own = rng.choices(words, k=rng.choice([40, 64, 150]))
        for changes in (0, 1, 1, 2, 3, 4):
            copy = list(own)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out + [f"{line} {' '.join(rng.choices(words, k=20))}" for _ in range(40)]


def test_stage_links_near_copies_as_brute_force(spark, small):
    texts = near_copies()
    roots = least([shingle_set(t) for t in texts])
    assert 12 < len(set(roots[:72])) < 72
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


def test_tables_equal_brute_force(spark, small):
    docs = table(spark, small, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    roots = least([shingle_set(t) for _, t in rows])
    assert sorted(r.doc_id for r in overlap.one_of_each_group(docs).collect()) == sorted(rows[k][0] for k in set(roots))


def test_blocks_and_gaps_miss_no_pair():
    sizes = np.sort(np.random.default_rng(3).integers(1, 400, 300))
    met = {(a, b) for u in overlap.units(sizes, block=16) for a in u.tolist() for b in u.tolist()}
    assert all((a, b) in met for b in range(300) for a in range(b) if sizes[a] >= 0.8 * sizes[b])


def test_parities_bound_the_difference_of_sets():
    rng = np.random.default_rng(6)
    texts = near_copies() + [" ".join(f"v{x}" for x in rng.integers(0, 50_000, n)) for n in (1, 5, 66, 70, 130, 20_000)]
    sets = [overlap.shingles(t) for t in texts]
    marks = [overlap.parity(s) for s in sets]
    assert {len(m) for m in marks} >= {8, 16, 32, 2048}
    for a in range(len(sets)):
        for b in range(a):
            width = min(len(marks[a]), len(marks[b]))
            x, y = (overlap._folded([marks[k]], width) for k in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(sets[a], sets[b]))


def test_near_members_lose_no_link():
    texts = near_copies()
    sets = [overlap.shingles(t) for t in texts]
    found = overlap.near_members(np.array([len(s) for s in sets]), [overlap.parity(s) for s in sets])
    of = {k: g for g, x in enumerate(found) for k in x.tolist()}
    alike = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    assert alike and all(a in of and of[a] == of.get(b) for a, b in alike)
    # texts that only share a line are told apart
    assert not any(k in of for k in range(72, len(texts)))


def test_near_members_of_two_widths():
    """Two sets with parities of the smaller width and one of the larger are compared as they are, not as three of either."""
    rng = np.random.default_rng(8)
    whole = np.unique(rng.integers(0, 1 << 63, 70).astype(np.uint64))
    sets = [whole[:60], whole[:62], whole]
    marks = [overlap.parity(s) for s in sets]
    assert [len(m) for m in marks] == [8, 8, 16]
    assert [x.tolist() for x in overlap.near_members(np.array([len(s) for s in sets]), marks)] == [[0, 1, 2]]
    # a set of the larger width doesn't lend its row to a smaller one that is far from the rest
    other = np.unique(rng.integers(0, 1 << 63, 55).astype(np.uint64))
    sets = [other, whole, whole[:68]]
    assert [x.tolist() for x in overlap.near_members(np.array([len(s) for s in sets]), [overlap.parity(s) for s in sets])] == [[1, 2]]


def test_small_sets_are_linked(spark):
    short = "stab kmpa qjdb hawm onff ukzx lmfp eani"
    docs = spark.createDataFrame([(1, short), (2, f"{short} rbtp"), (3, "stab kmpa qjdb hawm onff other words here now")], "doc_id long, text string")
    assert sorted(r.doc_id for r in overlap.one_of_each_group(docs).collect()) == [1, 3]


def test_every_link_of_small_sets_survives():
    """Of 20,000 pairs of sets at the least likeness, none is lost: 4 of 5, 8 of 10 and 16 of 20 shingles."""
    rng = np.random.default_rng(7)
    for size in (5, 10, 20):
        for _ in range(7_000):
            both = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            less = np.sort(rng.choice(both, size * 4 // 5, replace=False))
            assert len(overlap.near_members(np.array([len(less), len(both)]), [overlap.parity(less), overlap.parity(both)])) == 1


def test_linked_equals_brute_force():
    sets = [overlap.shingles(t) for t in near_copies()]
    found = dict(overlap.linked(sets))
    assert [found.get(k, k) for k in range(len(sets))] == least([set(s.tolist()) for s in sets])


def test_odd_rows(spark, odd, nothing):
    kept = overlap.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 6, 7, 8]
    assert overlap.one_of_each_group(nothing).count() == 0
    assert overlap.one_of_each_group(odd.withColumn("text", F.lit(None).cast("string"))).count() == 1


def test_index_gives_links_and_whole_sets_confirm_them(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    one = rng.choices(words, k=600)
    passage = rng.choices(words, k=7)
    # 0 and 1 differ in a word; 2 and 3 repeat a passage, so that their fingerprints are the same, but not their sets
    texts = [" ".join(one), " ".join([*one[:-1], "other"]), *(" ".join(passage * 300 + rng.choices(words, k=20)) for _ in range(2))]
    counts = {}

    def counted(name):
        own = getattr(overlap, name)

        def run(*args):
            out = own(*args)
            counts[name] = out.count()
            return out

        monkeypatch.setattr(overlap, name, run)

    for name in ("indexed_pairs", "confirmed", "unlinked"):
        counted(name)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = overlap.one_of_each_group(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    # the index has both pairs, whole sets confirm one, and what the index has linked is not compared again
    assert counts == {"indexed_pairs": 2, "confirmed": 1, "unlinked": 0}
