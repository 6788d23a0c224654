import hashlib
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessella.llm.sharding import Splitters, op1_sharding, shard


def brute(rows, shards=16):
    """(doc_id, size, shard, slot) by sorting all rows."""
    key = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    order = sorted(((key(t), -(1 << 63) if i is None else i, len((t or "").encode()) + 1, i) for i, t in rows), key=lambda r: r[:3])
    total, before, out, slot = sum(r[2] for r in order), 0, [], Counter()
    for _, _, size, i in order:
        s = before * shards // total
        out.append((i, size, s, slot[s]))
        slot[s] += 1
        before += size
    return out


def result(df, shards=16):
    return [(r.doc_id, r["size"], r.shard, r.slot) for r in shard(df, shards).collect()]


def test_query_equals_sorting(spark, small, docs):
    got = op1_sharding(spark, small).collect()
    assert sorted((r.doc_id, r["size"], r.shard, r.slot) for r in got) == sorted(brute(docs))
    assert {r.doc_id: r.text_crc32 for r in got} == {i: zlib.crc32((t or "").encode()) for i, t in docs}
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_hot_group_is_cut_by_id(spark):
    rows = [(i, "same text") for i in range(3000)] + [(5000 + i, f"text {i}" * (i % 7)) for i in range(1000)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(got) == sorted(brute(rows))
    by = Counter()
    for _, size, s, _ in got:
        by[s] += size
    assert len(by) == 16 and max(by.values()) - min(by.values()) < 100


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = result(odd)
    none = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(none, got)) == sorted(map(none, brute(rows)))
    assert shard(nothing).count() == 0
    assert shard(odd).columns[:5] == odd.columns[:5]


def test_extreme_ids(spark):
    rows = [(i, "t") for i in (-(1 << 63), (1 << 63) - 1, 0, -5)] + [(7, "u")]
    assert sorted(result(spark.createDataFrame(rows, "doc_id long, text string"), 4)) == sorted(brute(rows, 4))


def test_tolerance_stops_early(spark):
    random.seed(2)
    rows = [(random.getrandbits(60), i, 10) for i in range(5000)]
    found = Splitters(spark.createDataFrame(rows, "k long, d long, size long"), ["k", "d"], 8, tolerance=5000)
    assert found.total == 50_000 and len(found.cuts) == 7
    for j, n in enumerate(found.before, 1):
        assert 0 <= n * 10 - found.total * j / 8 <= 5000 + 10


def test_repeated_rows_fill_all_shards(spark):
    rows = [(7, "the same row")] * 2000 + [(i, f"other {i}") for i in range(100)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    by = Counter(s for i, _, s, _ in got if i == 7)
    by_bytes = Counter()
    for _, size, s, _ in got:
        by_bytes[s] += size
    assert len(by) >= 15 and max(by_bytes.values()) - min(by_bytes.values()) <= 2 * 13
    assert sorted(got) == sorted(brute(rows))


def test_places_of_equal_keys(spark):
    """A key that fills several parts leaves them to its rows."""
    df = spark.createDataFrame([(0, 1)] * 100 + [(5, 1)] * 800 + [(9, 1)] * 100, "k long, size long")
    cuts = Splitters(df, ["k"], 10)
    got = {r.k: (r.p, r.p_more) for r in cuts.place(df, "p").distinct().collect()}
    assert got[0][0] == 0 and got[5] == (1, 7) and got[9][0] == 9
    few = Splitters(df.selectExpr("k", "size * 1000 size").where("rand(1) < 0.1"), ["k"], 10)
    assert {r.p_more for r in few.place(df, "p").collect()} == {0}
