import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import setsketch


def shingles(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def expected(rows):
    """doc_id: (size, component, kept) by trying all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least.setdefault(find(n), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted(((i, len(sets[n]), least[find(n)], i == least[find(n)]) for n, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in setsketch.near_duplicates(df).collect()), key=str)


def test_query(spark, small, docs):
    found = sorted(map(tuple, setsketch.op12_minhash(spark, small).collect()), key=str)
    assert found == expected(docs)
    assert sum(not k for *_, k in found) > 3


def edited(rng, words, share):
    return [rng.choice("xyzuvw") + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def test_chains_and_ties(spark):
    """Texts at and about the threshold, short ones among them; links over several steps; groups that only some members connect."""
    rng, rows = random.Random(3), []
    for g in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 4, 7, 8, 12, 30, 80, 300]))]
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)))
            words = edited(rng, words, rng.choice([0, 0.01, 0.03, 0.06])) + ["end"] * rng.randint(0, 1)
    base = "stab kmpa qjdb hawm onff ukzx lmfp eani"
    rows += [(9001, base), (9002, base + " rbtp"), (9003, base + " rbtp more")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == expected(rows)


def test_hot_group(spark):
    """A third of all rows are near copies of one text, some beside it only share a part; pairs stay as many as rows."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = [(n, " ".join(edited(rng, base, 0.002))) for n in range(400)]
    rows += [(1000 + n, " ".join(base[:90] + [f"v{rng.randrange(4000)}" for _ in range(60)])) for n in range(40)]
    rows += [(2000 + n, " ".join(f"u{rng.randrange(4000)}" for _ in range(60))) for n in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == expected(rows)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == expected(rows)
    assert setsketch.near_duplicates(nothing).collect() == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    for shared, left, right in [(800, 100, 100), (500, 500, 0), (50, 950, 950), (10, 0, 2)]:
        x = rng.integers(0, 1 << 63, shared + left + right, dtype=np.uint64)
        a, b = np.unique(x[: shared + left]), np.unique(np.concatenate([x[:shared], x[shared + left :]]))
        ra, rb = setsketch.registers(a), setsketch.registers(b)
        assert np.array_equal(setsketch.merge(ra, rb), setsketch.registers(np.union1d(a, b)))
        j, _, _ = setsketch.estimate(ra[None], rb[None], np.array([float(len(a))]), np.array([float(len(b))]))
        assert abs(j[0] - shared / (shared + left + right)) < 0.13


def test_likelihood_keeps_all_at_the_threshold():
    """Of 300 pairs at exactly 0.8 none is ruled out, of 300 at 0.3 nearly all are."""
    rng = np.random.default_rng(1)

    def pairs(shared, own):
        out = []
        for _ in range(300):
            x = rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
            out.append((setsketch.registers(x[: shared + own]), setsketch.registers(np.concatenate([x[:shared], x[shared + own :]]))))
        n = np.full(300, float(shared + own))
        return setsketch.likely(np.array([p[0] for p in out]), np.array([p[1] for p in out]), n, n)

    assert pairs(80, 10).all() and pairs(30, 35).mean() < 0.01


def test_bands_are_shared():
    """The share of bands that pairs at 0.8 have in common is about 0.8 ** 4."""
    rng, hits = np.random.default_rng(2), []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = (setsketch.registers(y).reshape(-1, setsketch.ROWS) for y in (x[:90], np.concatenate([x[:80], x[90:]])))
        hits.append((a == b).all(axis=1).mean())
    assert 0.37 < np.mean(hits) < 0.46 and min(hits) > 0


def test_fewer_words_are_one_shingle():
    assert len(setsketch.shingles("A b")) == 1 and np.array_equal(setsketch.shingles("A b"), setsketch.shingles("a  B"))
    assert not np.array_equal(setsketch.shingles("a b"), setsketch.shingles("a b c"))
    assert len(setsketch.shingles(" \n")) == 0 and len(setsketch.shingles("a b c d a b c d")) == 4


def test_column_names_may_clash(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string").withColumns({c: F.lit(0) for c in ("id", "key", "sketch", "n", "root", "node", "band")})
    assert got(df) == [(1, 3, 1, True)]


@pytest.mark.parametrize("cell", [1 << 19, 600])
def test_spread_group(spark, cell, monkeypatch):
    """Copies of one text with few to many edits: some are linked over others only, some with none; cells of all and of a few members."""
    monkeypatch.setattr(setsketch, "CELL", cell)
    rng = random.Random(8)
    base = [f"w{rng.randrange(4000)}" for _ in range(100)]
    rows = [(n, " ".join(edited(rng, base, rng.choice([0.005, 0.02, 0.04, 0.06])))) for n in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == expected(rows)


def test_cell_links_span_what_is_linked():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 60 - int(k)], rng.integers(0, 1 << 63, int(k), dtype=np.uint64)])) for k in rng.integers(0, 14, 40)]
    items = [(n, n % 25, s) for n, s in enumerate(sets)]
    links = setsketch.cell_links(items[:20], items[10:])
    assert all(setsketch.alike(sets[a], sets[b]) and a % 25 != b % 25 for a, b in links) and len(links) < 25
    root = list(range(25))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a % 25)] = find(b % 25)
    for a in range(20):
        for b in range(10, 40):
            assert not setsketch.alike(sets[a], sets[b]) or find(a % 25) == find(b % 25)


def test_only_texts_that_are_asked_for_are_shuffled(spark, monkeypatch):
    """Of 3,000 texts the join gets those of the sets asked for, and hardly any others."""
    from tessella.llm.common import Scratch, may_have, row_key

    seen = []
    monkeypatch.setattr(setsketch, "may_have", lambda *a: seen.append(may_have(*a).count()) or may_have(*a))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("text %d of many words", F.col("id")).alias("text"))
    df = df.unionByName(df.where("doc_id < 10"))  # repeated rows share a set
    work = Scratch(spark, "texts")
    texts = work.save(df.select(row_key().alias("row"), "text"))
    sets = work.save(texts.dropDuplicates(["row"]).select("row", F.split("text", " ")[1].cast("long").alias("id")))
    wanted = spark.createDataFrame([(i,) for i in range(0, 900, 7)], "id long")
    found = setsketch._Links(sets, texts, work, 4, 80).whole(wanted).collect()
    assert sorted((r.id, bytes(r.set)) for r in found) == [(i, setsketch.shingles(f"text {i} of many words").tobytes()) for i in range(0, 900, 7)]
    assert 131 <= seen[0] <= 140


def test_buckets_of_the_same_members_are_tried_once(spark, monkeypatch):
    plans, save = [], setsketch.Scratch.save
    monkeypatch.setattr(setsketch.Scratch, "save", lambda self, df: plans.append(save(self, df)) or plans[-1])
    work = setsketch.Scratch(spark, "buckets")
    sets = work.save(spark.createDataFrame([(i, bytes([i]), 4) for i in range(1, 6)], "id long, row binary, n long"))
    texts = work.save(spark.createDataFrame([(bytes([i]), f"a b c d e f{i}") for i in range(1, 6)], "row binary, text string"))
    rest = spark.createDataFrame([(b, i, i) for b, ids in ((1, (1, 2)), (2, (1, 2)), (3, (1, 2, 3)), (4, (4, 5))) for i in ids], "bucket long, id long, root long")
    links = setsketch._Links(sets, texts, work, 4, 80)
    links.found = spark.createDataFrame([], "a long, b long")
    links.across(rest)
    kept = next(p for p in plans if p.columns == ["bucket", "id", "root"])
    assert sorted((r.bucket, r.id) for r in kept.collect()) == [(1, 1), (1, 2), (3, 1), (3, 2), (3, 3), (4, 4), (4, 5)]
