import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import phrases


def words_of(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", t)]


def expected(rows, least, longest, top):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for w in words_of(text):
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                count[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {(p[i : i + m], a) for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)}
        own = []
        for p, a in candidates.items():
            if (p, a) in inside:
                continue
            s, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            own.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(map(tuple, phrases.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("block", [1 << 21, 40])
def test_brute_force(spark, block):
    """Zipf words, repeats that overlap, separators of all kinds, several languages; blocks of all rows and of a few words."""
    rng = random.Random(block)
    vocabulary = ["the", "of", "La", "é", "x'y", "\x1c", "a\xa0b", "IN"] + [f"w{i}" for i in range(30)]
    seps = [" ", " ", " ", " ", " ", "\t", "  ", ". ", ",", "; ", ":", "!", "?", "\n", "\r\n", "\x0b", "\x0c"]
    rows = []
    for _ in range(300):
        t = "".join(vocabulary[min(int(rng.paretovariate(0.8)) - 1, len(vocabulary) - 1)] + rng.choice(seps) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "en", "fr", None]), t))
    rows += [("en", "new york stock exchange rules")] * 25 + [(None, None), ("de", ""), ("de", " .\n")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for least, top in ((4, 2000), (20, 7)):
        assert got(df, least=least, top=top, block=block) == expected(rows, least, 5, top)


def test_query_equals_brute_force(spark, small):
    from tessella.llm.common import table

    rows = [tuple(r) for r in table(spark, small, "documents").select("lang", "text").collect()]
    assert got(table(spark, small, "documents"), least=20, top=50) == expected(rows, 20, 5, 50)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert got(odd, least=2) == expected(rows, 2, 5, 2000)
    assert got(odd) == expected(rows, 100, 5, 2000)
    assert got(nothing) == []


def test_hot_words_keep_a_row_a_block(spark):
    """One word makes up a third of all words: each block has a row for it, not one for each place."""
    rows = [("en", " ".join(f"hot w{(i + j) % 50}" for j in range(20))) for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    assert got(df, least=30) == expected(rows, 30, 5, 2000)


def test_score_is_exact(spark):
    cases = [(10**15 - 1, 10**15 - 7, 3 * 10**14, 10**12 + 1), (100, 2, 3, 7), (999_999_999_999_989, 10**15 - 11, 10**15 - 1, 10**15 - 3)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long").select("a", "n", "l", "r", phrases.score("a", "n", "l", "r").alias("s"))
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in df.collect())


def test_lists_and_joins():
    words, sizes, at = phrases.positions(["A b, a", "b"])
    assert words == ["a", "b"] and sizes.tolist() == [2, 2] and at.tolist() == [0, 3, 1, 5]
    ids, at = phrases.flat(*phrases.packed(np.array([5, 4, 5]), np.array([2, 7, 9])))
    assert ids.tolist() == [5, 4, 5] and at.tolist() == [2, 7, 9]
    assert [x.tolist() for x in phrases.meet(np.array([1, 4, 6]), np.array([0, 4, 5, 6]))] == [[1, 2], [1, 3]]
    assert phrases.meet(np.array([1]), np.array([], dtype=np.int64))[0].tolist() == []


def test_pairs_are_numbered_without_a_join(spark, monkeypatch):
    plans, save = [], phrases.Scratch.save
    monkeypatch.setattr(phrases.Scratch, "save", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(self, df))
    counts = spark.createDataFrame([(p, w, b, 30) for p in range(3) for w in range(4) for b in range(p + w)], "p long, w long, block long, n long")
    frequent, rows = phrases._frequent(counts, ["p", "w"], 100, phrases.Scratch(spark, "pairs"))
    ids = {(r.p, r.w): (r.f, r.id) for r in frequent.collect()}
    assert {k: v[0] for k, v in ids.items()} == {(p, w): 30 * (p + w) for p in range(3) for w in range(4) if p + w > 3}
    assert len({v[1] for v in ids.values()}) == len(ids) and all(ids[r.p, r.w][1] == r.id for r in rows.collect()) and rows.count() == sum(p + w for p, w in ids)
    assert plans and not any("Join" in p for p in plans)


def test_lists_of_blocks_stay_where_they_are(spark, monkeypatch):
    """Names come to the blocks: no step deals out the blocks' lists, not even where names are too many to be broadcast."""
    plans, save = [], phrases.Scratch.save
    monkeypatch.setattr(phrases.Scratch, "save", lambda self, df, **kw: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or save(self, df, **kw))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("en", "new york stock exchange rules all")] * 30 + [(None, "a b a b a b a")] * 20
        assert got(spark.createDataFrame(rows, "lang string, text string").repartition(3), least=10) == expected(rows, 10, 5, 2000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    steps = [p for columns, p in plans if "w_steps" in columns]
    # the one exchange is that of the names
    assert len(steps) == 4 and all("Join" in p and p.count("Exchange hashpartitioning") == 1 for p in steps)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("phrases_")]


def test_packed_pairs():
    rng = np.random.default_rng(1)
    columns = [rng.integers(-(2**40), 2**40, 500), np.zeros(500, np.int64), np.arange(500)]
    assert [x.tolist() for x in phrases.unpack(phrases.pack(*columns), 500)] == [x.tolist() for x in columns]
    # a pair that occurs once in a block takes a few bytes, not a row of four numbers
    p, w = np.sort(rng.integers(0, 20_000, 5_000)), rng.integers(0, 20_000, 5_000)
    assert len(phrases.pack(np.diff(p, prepend=0), w, np.ones(5_000, np.int64))) < 4 * 5_000
    # a very common word's pairs are in all parts alike
    parts = np.bincount(phrases.part_of(np.full(20_000, 7), np.arange(20_000), 40), minlength=40)
    assert parts.min() > 350 and parts.max() < 650
    own = (np.array([5, 1, 5]), np.array([2, 9, 1]))
    assert phrases.places(own, (np.array([1, 5, 5, 1, 8, 5]), np.array([9, 1, 2, 2, 9, 3]))).tolist() == [1, 2, 0, -1, -1, -1]
    assert phrases.places((own[0][:0], own[1][:0]), own).tolist() == [-1, -1, -1]


def test_frequent_pairs_of_all_blocks(spark):
    """Frequencies are summed over blocks; a pair has one number, and each block that has it is told."""
    rng = random.Random(5)
    n = {(b, p, w): rng.randint(1, 40) for b in range(6) for p in range(12) for w in range(12) if rng.random() < 0.6}
    cells = defaultdict(list)
    for (b, p, w), x in sorted(n.items()):
        cells[int(phrases.part_of(np.array([p]), np.array([w]), 5)[0]), b].append((p, w, x))
    rows = [(part, b, len(c), phrases.pack(np.diff([x[0] for x in c], prepend=0), *(np.array([x[i] for x in c]) for i in (1, 2)))) for (part, b), c in cells.items()]
    counts = spark.createDataFrame(rows, "part long, block long, size long, pairs binary")
    frequent, named = phrases._frequent_pairs(counts, 80, 5, phrases.Scratch(spark, "pairs"))
    f = Counter()
    for (_, p, w), x in n.items():
        f[p, w] += x
    ids = {(r.p, r.w): (r.f, r.id) for r in frequent.collect()}
    assert {k: v[0] for k, v in ids.items()} == {k: v for k, v in f.items() if v >= 80} and 0 < len(ids) < len(f)
    assert len({v[1] for v in ids.values()}) == len(ids)
    told = set()
    for r in named.where("block is not null").collect():
        p, w, name = phrases.unpack(bytes(r.pairs), r.size)
        told |= {(r.block, *x) for x in zip(np.cumsum(p).tolist(), w.tolist(), np.cumsum(name).tolist(), strict=True)}
    assert told == {(b, p, w, ids[p, w][1]) for b, p, w in n if (p, w) in ids}
