import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions.embed import HashingEmbedder, embed
from tessella.operators import capacity, detect, index, parts, search, stats

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, step=10):
    return spark.createDataFrame([("k", T0 + dt.timedelta(seconds=step * i), i, float(v)) for i, v in enumerate(values)], "k string, ts timestamp, id int, v double")


def test_trend(spark):
    rise = detect.time_to_threshold(series(spark, [70 + 0.5 * i for i in range(30)]), "v", "ts", ["k"], 90).orderBy("ts").collect()
    assert rise[8].eta is None and abs(rise[29].eta - (90 - 84.5) / 0.05) < 1e-6
    assert all(r.eta is None for r in detect.time_to_threshold(series(spark, [50] * 30), "v", "ts", ["k"], 90).collect())
    assert detect.time_to_threshold(series(spark, [91 + i for i in range(30)]), "v", "ts", ["k"], 90).orderBy(F.desc("ts")).first().eta == 0.0


def test_ewma_zero_is_unset(spark):
    got = detect.baselines(series(spark, [0, 50, 60, 0]), "v", 0.2, ["k"], ["ts", "id"]).orderBy("ts").collect()
    assert [round(r.after, 6) for r in got] == [0, 50, 52, 41.6]
    assert [round(r.before, 6) for r in got] == [0, 0, 50, 52]


def test_rate_window_is_open(spark):
    got = detect.rate_per_minute(series(spark, [0] * 40), "ts", ["k"]).orderBy("ts").collect()
    assert got[0].rate == 0.0 and got[1].rate == 2 / (10 / 60)
    assert abs(got[39].rate - 30 / (290 / 60)) < 1e-9  # the row 300 s before doesn't count
    capped = detect.rate_per_minute(series(spark, [0] * 40), "ts", ["k"], most=5).orderBy(F.desc("ts")).first()
    assert abs(capped.rate - 5 / (40 / 60)) < 1e-9


def test_new_listener(spark):
    rows = [("h", 1, [22, 80]), ("h", 2, [22, 80, 4444]), ("h", 3, [22, 443]), ("h", 4, [22, 4444])]
    got = detect.new_members(spark.createDataFrame(rows, "h string, c int, p array<int>"), "p", ["h"], "c", detect.EXPECTED_PORTS).orderBy("c").collect()
    assert [r.added for r in got] == [[], [4444], [], [4444]]


def test_sustained_needs_more_than_the_time(spark):
    got = detect.sustained(series(spark, [95] * 8 + [10] + [95] * 3), "v", "ts", ["k"], ["ts", "id"], 90, 60).collect()
    assert [(r.id, r.sustained_sec) for r in got] == [(7, 70.0)]


def test_limiter_ignores_denied(spark):
    random.seed(3)
    at = sorted(random.sample(range(600), 60))
    df = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=s), i) for i, s in enumerate(at)], "k string, ts timestamp, id int")
    held, expected = [], {}
    for i, s in enumerate(at):
        held = [t for t in held if s - t <= 60]
        expected[i] = len(held) < 5
        held += [s] * expected[i]
    assert {r.id: r.allowed for r in detect.restart_limiter(df, "ts", ["k"], "id").collect()} == expected


def test_rest_for_one(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, start_order int")
    got = {r.name: (r.stop_place, r.start_place) for r in detect.after(df, "b").collect()}
    assert got == {"b": (2, 1), "c": (1, 2)}


def test_change_detection(spark):
    schema = "path string, size_bytes long, mtime_ns long, content_hash string"
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "x"), ("d", 1, 1, "x")], schema)
    now = spark.createDataFrame([("a", 1, 1, None), ("b", 1, 2, "x"), ("c", 2, 1, "y"), ("d", 2, 2, None), ("e", 1, 1, "z")], schema)
    assert {r.path for r in index.needs_indexing(now, old).collect()} == {"c", "d", "e"}
    assert {r.path for r in index.to_hash(now, old).collect()} == {"b", "c", "d"}


def test_zip_shorter(spark):
    df = spark.createDataFrame([(["x", "y", "z"], [[1.0], [2.0]])], "c array<string>, e array<array<double>>")
    assert [tuple(x) for x in df.select(index.zip_shorter(F.col("c"), F.col("e")).alias("z")).first().z] == [("x", [1.0]), ("y", [2.0])]


def test_latest_by_key_deletes(spark):
    df = spark.createDataFrame([("a", "k", "1", 1), ("a", "k", "2", 2), ("a", "g", "1", 1), ("a", "g", None, 3)], "agent string, key string, value string, updated_at int")
    assert [tuple(r) for r in index.latest_by_key(df, "agent", "key").collect()] == [("a", "k", "2", 2)]


def test_hybrid_prefers_dual_match_then_path(spark):
    docs = [(1, "python database helpers for web apps", "/src/api_handler.py"), (2, "unrelated content xyz", "/src/utils.py")]
    vectors = [(1, [1.0, 0.0]), (2, [0.9, 0.1])]
    d, v = spark.createDataFrame(docs, "id long, text string, path string"), spark.createDataFrame(vectors, "id long, embedding array<float>")
    assert search.hybrid_search(d, v, "python database", [0.9, 0.1]).orderBy("result_rank").first().id == 1
    assert search.hybrid_search(d, v, "utils", [0.95, 0.05]).orderBy("result_rank").first().id == 2
    assert search.hybrid_search(d.limit(0), v.limit(0), "x", [1.0, 0.0]).count() == 0


def test_phrase_counts_overlaps(spark):
    df = spark.createDataFrame([("on on on the ON, the",)], "t string")
    assert df.select(search.phrase_hits(F.col("t"), "on the").alias("n")).first().n == 2
    assert df.select(search.phrase_hits(F.col("t"), "on on").alias("n")).first().n == 2


def test_embedder(spark):
    df = spark.createDataFrame([(1, "b a"), (2, "a b"), (3, None), (4, "c")], "id int, t string")
    e = {r.id: list(r.embedding) for r in embed(df, "t", HashingEmbedder(8), batch=2).collect()}
    assert e[1] == e[2] and abs(sum(x * x for x in e[1]) - 1) < 1e-6 and not any(e[3])


def test_capacity(spark):
    slots = spark.createDataFrame([("h", "a", 100, T0), ("h", "b", 200, T0 + dt.timedelta(1)), ("h", "c", 300, T0 + dt.timedelta(2))], "host string, model_id string, vram_mb long, last_used timestamp")
    assert [r.model_id for r in capacity.to_evict(slots, 250).orderBy("last_used").collect()] == ["a", "b"]
    assert capacity.to_evict(slots, 0).count() == 0
    hosts = spark.createDataFrame([("h", 1000, 850), ("g", 1000, 0)], "host string, total_mb long, used_mb long")
    got = {r.host: (r.shortfall, r.can_free, r.outcome) for r in capacity.plan(hosts, slots, F.lit(300)).collect()}
    assert got == {"h": (250, 300, "evict"), "g": (0, 0, "fits")}


def test_join_tokens_stops_at_done(spark):
    df = spark.createDataFrame([("s", 1, "Hello", False), ("s", 2, " from", False), ("s", 3, "x", True), ("s", 4, "y", False)], "s string, i int, token string, done boolean")
    assert stats.join_tokens(df, ["s"], "i", done=F.col("done")).first().text == "Hello from"


def test_folds_go_through_keys_of_any_size(spark):
    """One key with most rows, nulls among values; the same as a loop."""
    rows = [("hot", i, float(i * 7919 % 101) if i % 50 else None) for i in range(25_000)] + [(None, 1, 5.0), ("x", 2, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts long, v double")
    base = 0.0
    for _, _, v in rows[:25_000]:
        base = base if v is None else v if base == 0 else 0.1 * v + 0.9 * base
    got = {r.k: (r.n, r.ewma) for r in detect.ewma(df, "v", 0.1, ["k"], ["ts"]).collect()}
    assert got["hot"] == (25_000, base) and got[None] == (1, 5.0) and got["x"] == (1, 1.0)


def _loop(values, alpha):
    b, out = 0.0, []
    for v in values:
        before, b = b, b if v is None else v if b == 0 else alpha * v + (1 - alpha) * b
        out.append((before, b))
    return out


def test_scan_equals_a_loop(spark):
    """Keys of one row to most rows, leading zeros and nulls, all nulls, and values of both signs that cancel out."""
    rng = random.Random(2)
    series = {"hot": [rng.choice([None, 0.0, rng.random() * 100]) for _ in range(3000)], "zeros": [0.0, None, 0.0, 0.0, 5.0, 0.0, 7.0], "nulls": [None] * 5, None: [3.0], "cancel": [4.0, -4.0, 8.0, -8.0, 6.0, 2.0] * 30, "less": [-1.0, -2.0, None, -3.0]}
    rows = [(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v double")
    for alpha in (0.1, 0.5):
        got = {(r.k, r.i): (r.before, r.after) for r in detect.baselines(df, "v", alpha, ["k"], ["i"]).collect()}
        assert len(got) == len(rows)
        for k, vs in series.items():
            for i, (before, after) in enumerate(_loop(vs, alpha)):
                assert got[k, i] == pytest.approx((before, after), rel=1e-12, abs=0)


def test_scan_spreads_a_hot_key(spark):
    """The rows of one key are in several parts, and no stage of the scan deals them by the key alone."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"), (F.col("id") % 97).cast("double").alias("v"))
    cut = parts.in_parts(df, ["k"], ["i"])
    sizes = [r["count"] for r in cut.groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5000
    plan = detect.baselines(df, "v", 0.1, ["k"], ["i"])._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any("__part" in d for d in dealt)


@pytest.mark.parametrize("stretch", [1, 2, 7])
def test_rates_have_a_halo(spark, stretch):
    """Windows across the borders of stretches, rows at the edge of a window, equal times, dense and sparse keys, times before 1970."""
    rng = random.Random(stretch)
    rows = [(k, i, int(1e6 * rng.choice([rng.randint(-900, 900), rng.uniform(-900, 900)]))) for k, n in (("dense", 400), ("thin", 20), (None, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, id int, us long").withColumn("ts", F.timestamp_micros("us"))
    got = {(r.k, r.id): r.rate for r in detect.rate_per_minute(df, "ts", ["k"], 60, 15, stretch).collect()}
    assert len(got) == len(rows)
    for k, i, t in rows:
        own = sorted(u for q, _, u in rows if q == k and t - 60_000_000 < u <= t)[-15:]
        expected = 0.0 if len(own) < 2 or own[0] == t else len(own) / ((t - own[0]) / 60e6)
        assert got[k, i] == pytest.approx(expected, rel=1e-12)


def test_prefix_sums_are_spread(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50), i, rng.randrange(100)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    for by in ([], ["k"]):
        got = {r.id: r.s for r in parts.prefix_sum(df, by, ["t", "id"], F.col("v"), "s").collect()}
        for k, t, i, _ in rows:
            assert got[i] == sum(v for q, u, j, v in rows if (not by or q == k) and (u, j) < (t, i))
    cut = parts.in_parts(df, [], ["t", "id"])
    assert cut.select("__part").distinct().count() == 8


def test_evicts_over_all_slots(spark):
    df = spark.createDataFrame([(f"m{i:03d}", i // 3, 10) for i in range(300)], "model_id string, last_used int, vram_mb int")
    assert sorted(r.model_id for r in capacity.to_evict(df, 95).collect()) == [f"m{i:03d}" for i in range(10)]
    agents = spark.createDataFrame([(f"a{i}", i * 2) for i in range(100)], "name string, start_order int")
    got = {r.name: (r.stop_place, r.start_place) for r in detect.after(agents, "a90").collect()}
    assert got == {f"a{i}": (100 - i, i - 89) for i in range(90, 100)} and detect.after(agents, "none").count() == 0
