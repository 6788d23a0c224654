import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import syncmers


def edits(rows):
    """doc_id: (text, edited text, next text)."""
    order = sorted(rows, key=lambda r: r[0], reverse=True)
    out = {}
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        k = len(t) // 3
        out[i] = (t, t[: len(t) - k] + after[:k], after)
    return out


def marks(texts, hashes, pair):
    """The fingerprint of each text by the definition, unit by unit; `hashes` hashes units and `pair` lists of longs."""
    lists, out = [], []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t) if len(t) >= 128 else []
        lists += [w, list(t) if len(t) < 384 else []]
    known = hashes({u for x in lists for u in x})
    grams, anchors = set(), []
    for x in lists:
        h = [known[u] for u in x]
        k = 5
        mine = [(p, tuple(h[p : p + k])) for p in range(len(h) - k + 1) if min(h[p : p + k]) in (h[p], h[p + k - 1])]
        if 0 < len(h) < k and x and len(x[0]) == 1:
            mine = [(0, tuple(h))]
        anchors.append(mine)
        grams |= {g for _, g in mine}
    of = pair(grams, False)
    chains = [[(of[g], of[mine[i + 1][1]] if i + 1 < len(mine) else 0, mine[i + 1][0] - p if i + 1 < len(mine) else 0) for i, (p, g) in enumerate(mine)] for mine in anchors]
    value = pair({c for x in chains for c in x}, True)
    for k in range(0, len(chains), 2):
        out.append([v for x in chains[k : k + 2] for v in dict.fromkeys(value[c] for c in x)])
    return out


@pytest.fixture(scope="module")
def brute(spark):
    def hashes(units):
        rows = spark.createDataFrame([(u,) for u in units], "u string").select("u", F.xxhash64("u").alias("h")).collect()
        return {r.u: r.h for r in rows}

    def pair(lists, distance):
        if distance:
            rows = spark.createDataFrame(list(lists), "a long, b long, c int")
            return {(r.a, r.b, r.c): r.h for r in rows.select("*", F.xxhash64("a", "b", "c").alias("h")).collect()}
        out = {}
        for size in {len(g) for g in lists}:
            names = [f"c{i}" for i in range(size)]
            rows = spark.createDataFrame([g for g in lists if len(g) == size], ", ".join(f"{n} long" for n in names))
            # a text of fewer units is hashed as an array, which chains the hash over its elements as columns do
            out |= {tuple(r[n] for n in names): r.h for r in rows.select("*", F.xxhash64(*names).alias("h")).collect()}
        return out

    return lambda texts: marks(texts, hashes, pair)


def alike(a, b):
    return 2 * len(set(a) & set(b)) / (len(a) + len(b)) if a or b else 1.0


def test_query_equals_brute_force(spark, small, docs, brute):
    got = {r.doc_id: r for r in syncmers.op6_syncmers(spark, small).collect()}
    expected = edits([(i, t or "") for i, t in docs])
    flat = brute([x for i in expected for x in expected[i]])
    hexes = lambda fp: "".join(f"{x & (1 << 64) - 1:016x}" for x in fp)
    assert set(got) == set(expected)
    for n, (i, (t, e, _)) in enumerate(expected.items()):
        own, edited, after = flat[3 * n : 3 * n + 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexes(own), hexes(edited))
        assert abs(r.near_edited - alike(own, edited)) < 1e-12 and abs(r.near_next - alike(own, after)) < 1e-12


def test_edited_texts_stay_alike(spark, small):
    """Two thirds of a text are left in the edited one: also of short texts the likeness shows it."""
    rows = syncmers.op6_syncmers(spark, small).collect()
    long, short = ([r for r in rows if (r.n_chars >= 200) == x and r.n_chars >= 12] for x in (True, False))
    assert sum(r.near_edited > max(0.4, r.near_next) for r in long) >= 0.95 * len(long)
    assert sum(r.near_edited > r.near_next for r in short) >= 0.9 * len(short)


def test_closed_syncmers_by_definition(spark):
    text = "the cat sat on the mat and the cat sat on the hat " * 4
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    w = text.split()
    known = {r.w: r.h for r in spark.createDataFrame([(x,) for x in set(w)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    h = [known[x] for x in w]
    expected = [p for p in range(len(h) - 4) if min(h[p : p + 5]) in (h[p], h[p + 4])]
    got = syncmers.anchors(df).where("unit = 'word'").orderBy("position").collect()
    assert [r.position for r in got] == expected
    mark = {r.position: r.hash for r in got}
    assert all((mark[a] == mark[b]) == (w[a : a + 5] == w[b : b + 5]) for a in mark for b in mark)  # the same in any context


def test_shifted_passages_match_and_other_distances_do_not(spark):
    passage = " ".join(f"word{i}" for i in range(100))
    rows = [(1, passage), (2, "something else stands before it " * 3 + passage), (3, " ".join(f"word{i} x" for i in range(100)))]
    got = {r.doc_id: r.fp for r in syncmers.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "fp").collect()}
    assert len(set(got[1]) & set(got[2])) >= len(got[1]) - 2 and not set(got[1]) & set(got[3])


def test_no_anchor_is_left_out(spark):
    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(20_000))
    r = syncmers.with_fingerprint(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", "fp").first()
    assert len(r.fp) > 0.3 * 20_000


def test_next_over_many_parts(spark):
    rows = [(i * 7 - 3000, f"t{i}") for i in range(1000)]
    got = syncmers.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"]).collect()
    order = sorted(rows, reverse=True)
    assert {r.doc_id: r.next_text for r in got} == {order[n][0]: order[(n + 1) % 1000][1] for n in range(1000)}
    one = syncmers.with_next(spark.createDataFrame(rows[:1], "doc_id long, text string"), ["text"]).collect()
    assert [r.next_text for r in one] == ["t0"]


def test_rows_of_one_id(spark):
    """Rows that repeat doc_id and text fill many parts; all but one are followed by their like."""
    rows = [(5, "same")] * 900 + [(i, f"t{i}") for i in range(5)] + [(9, "last")]
    got = syncmers.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), ["text"]).collect()
    assert sorted((r.doc_id, r.next_text) for r in got) == sorted([(9, "same"), *[(5, "same")] * 899, (5, "t4"), *[(i, f"t{i - 1}") for i in range(1, 5)], (0, "last")])


def test_odd_rows(spark, odd, nothing):
    df = syncmers.with_fingerprint(odd, "text", "print")
    got = {r.doc_id: r["print"] for r in df.collect()}
    assert got[1] == got[2] and got[3] == got[4] == [] and len(got[6]) == 0 and 1 <= len(got[7]) <= 2
    assert syncmers.with_next(df, ["text"]).count() == odd.count()
    assert syncmers.with_next(nothing, ["text"]).count() == 0
