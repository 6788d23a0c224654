"""Detectors as streams equal those on whole tables, though rows come shuffled in micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import detect
from tessella.streaming import ordered

T0 = dt.datetime(2024, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(STORE)


def shuffled(spark, rows, schema, tmp_path, files=4, late=40):
    """A stream over `rows` (key, seconds, id, item): each file holds a stretch of time, with rows moved to the next file that are at most `late` seconds behind."""
    rng, end = random.Random(7), max(r[1] for r in rows) + 1
    of = [[] for _ in range(files)]
    for r in rows:
        k = int(r[1] * files / end)
        border = (k + 1) * end / files
        of[min(k + (border - r[1] < late and rng.random() < 0.5), files - 1)].append(r)
    of.append([("zz", end + 10_000, -1, rows[0][3]), ("zz", end + 20_000, -2, rows[0][3])])
    at = f"{tmp_path}/in"
    for part in of:
        rng.shuffle(part)
        df = spark.createDataFrame([(k, T0 + dt.timedelta(milliseconds=int(1000 * s)), i, x) for k, s, i, x in part], schema)
        df.coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at), spark.read.schema(schema).parquet(at).where("k <> 'zz'")


def drain(df, name, spark, tmp_path):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).where("k <> 'zz'")


def rows_of(df, *columns):
    one = lambda x: round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x
    return sorted((tuple(one(r[c]) for c in columns) for r in df.collect()), key=str)


def times(n, seed, ties=False):
    rng, at, out = random.Random(seed), 0.0, []
    for _ in range(n):
        at += rng.choice([0, 1, 2, 5, 30] if ties else [1, 2, 5, 30])
        out.append(at)
    return out


def test_rates(spark, tmp_path):
    rows = [(k, s, 1000 * j + i, None) for j, k in enumerate("ab") for i, s in enumerate(times(120, j, ties=True))]
    stream, table = shuffled(spark, rows, "k string, ts timestamp, id int, item int", tmp_path)
    got = drain(ordered.rates(stream, ["k"], "ts", "id", 60, 8, late="50 seconds"), "o_rates", spark, tmp_path)
    expected = detect.rate_per_minute(table, "ts", ["k"], 60, 8)
    assert rows_of(got, "k", "id", "ts", "rate") == rows_of(expected, "k", "id", "ts", "rate") and got.count() == 240


def test_sustained(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, s, 1000 * j + i, rng.choice([95.0, 97.0, 99.0, 91.0, 92.0, 10.0, None])) for j, k in enumerate("ab") for i, s in enumerate(times(150, j))]
    stream, table = shuffled(spark, rows, "k string, ts timestamp, id int, item double", tmp_path)
    got = drain(ordered.sustained(stream, "item", ["k"], "ts", "id", 90, 15, late="50 seconds"), "o_high", spark, tmp_path)
    expected = detect.sustained(table, "item", "ts", ["k"], ["ts", "id"], 90, 15)
    columns = ["k", "id", "item", "sustained_sec"]
    assert rows_of(got, *columns) == rows_of(expected, *columns) and got.count() > 5


def test_trend(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, s, 1000 * j + i, 50 + i / 4 + rng.random()) for j, k in enumerate("ab") for i, s in enumerate(times(100, j))]
    stream, table = shuffled(spark, rows, "k string, ts timestamp, id int, item double", tmp_path)
    got = drain(ordered.time_to_threshold(stream, "item", ["k"], "ts", "id", 70, 5, 8, 20, late="50 seconds"), "o_eta", spark, tmp_path)
    expected = detect.time_to_threshold(table, "item", "ts", ["k"], 70, 5, 8, 20).withColumn("eta", F.round("eta", 5))
    assert rows_of(got.withColumn("eta", F.round("eta", 5)), "k", "id", "eta") == rows_of(expected, "k", "id", "eta")
    assert {0.0} < {r.eta for r in got.collect()} and got.where("eta is null").count() >= 8


def test_new_members(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, s, 1000 * j + i, sorted(rng.sample([22, 80, 4444, 5555, 6666], 3))) for j, k in enumerate("ab") for i, s in enumerate(times(60, j))]
    stream, table = shuffled(spark, rows, "k string, ts timestamp, id int, item array<int>", tmp_path)
    got = drain(ordered.new_members(stream, "item", ["k"], "ts", "id", [22, 80], late="50 seconds"), "o_new", spark, tmp_path)
    expected = detect.new_members(table, "item", ["k"], "ts", [22, 80])
    assert rows_of(got, "k", "id", "added") == rows_of(expected, "k", "id", "added") and got.where("size(added) > 0").count() > 5


def test_idle_keys_are_forgotten(spark, tmp_path):
    """A run that goes on after the key was idle begins anew; without `idle` it goes on."""
    rows = [("a", 0, 1, 99.0), ("a", 20, 2, 99.0), ("b", 100, 3, 1.0), ("b", 200, 4, 1.0), ("b", 400, 5, 1.0), ("a", 590, 6, 99.0), ("a", 599, 7, 99.0)]
    stream, _ = shuffled(spark, rows, "k string, ts timestamp, id int, item double", tmp_path, files=6, late=0)
    got = drain(ordered.sustained(stream, "item", ["k"], "ts", "id", 90, 15, late="1 second", idle=60), "o_idle", spark, tmp_path)
    assert rows_of(got, "id", "sustained_sec") == [(2, 20.0)]
