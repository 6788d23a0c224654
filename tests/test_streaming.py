import datetime as dt

from pyspark.sql import functions as F

from tessella.operators import detect
from tessella.operators.logindex import LogIndex
from tessella.streaming import detectors

T0 = dt.datetime(2024, 1, 1)


def drain(df, name, spark, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def as_stream(spark, df, tmp_path, name, files=2):
    at = f"{tmp_path}/{name}"
    for k in range(files):
        df.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(at)


def at(s):
    return T0 + dt.timedelta(milliseconds=int(1000 * s))


def test_debounce(spark, tmp_path):
    rows = [("a", at(0), "modified", 0), ("a", at(1), "modified", 0), ("b", at(0), "modified", 0), ("b", at(0.5), "deleted", 0), ("a", at(9), "modified", 0), ("z", at(100), "modified", 1), ("z", at(200), "modified", 1)]
    df = spark.createDataFrame(rows, "path string, ts timestamp, kind string, part int")
    got = drain(detectors.debounce(as_stream(spark, df, tmp_path, "in1")), "debounced", spark, tmp_path).collect()
    assert sorted((r.path, r.events) for r in got if r.path != "z") == [("a", 1), ("a", 2)]
    batch = detectors.debounce(df.drop("part")).where("path <> 'z'")
    assert sorted(map(tuple, batch.collect())) == sorted(tuple(r) for r in got if r.path != "z")


def test_unseen_across_batches(spark, tmp_path):
    rows = [("1-t", at(0), 0), ("1-t", at(1), 0), ("1-t", at(2), 1), ("2-t", at(3), 1)]
    df = spark.createDataFrame(rows, "id string, ts timestamp, part int")
    assert sorted(r.id for r in drain(detectors.unseen(as_stream(spark, df, tmp_path, "in2"), "id"), "unseen", spark, tmp_path).collect()) == ["1-t", "2-t"]


def test_spikes_equal_batch(spark, tmp_path):
    values = [10, 11, 9, 40, 10, 0, 50, 12, 11, 90]
    df = spark.createDataFrame([("u", i, float(v), i // 5) for i, v in enumerate(values)], "k string, i int, v double, part int")
    got = drain(detectors.spikes(as_stream(spark, df, tmp_path, "in3"), "k", "v", "i", 2.0), "spikes", spark, tmp_path)
    batch = detect.spikes(df, "v", ["k"], ["i"], 2.0)
    key = lambda d: sorted((r.k, r.i, r.v, round(r.before, 9)) for r in d.collect())
    assert key(got) == key(batch) and len(key(got)) == 3


def test_limiter_equals_batch(spark, tmp_path):
    rows = [("a", at(3 * i), i, i // 10) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, part int")
    stream = as_stream(spark, df, tmp_path, "in4").withColumn("us", F.unix_micros("ts"))
    got = drain(detectors.restart_limiter(stream, "k", "us", "id", 5, 30), "limited", spark, tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, detect.restart_limiter(df, "ts", ["k"], "id", 5, 30).collect()))


def test_windowed_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", at(60 * i), i // 6) for i in range(12)], "k string, ts timestamp, part int")
    got = drain(detectors.counts(as_stream(spark, df, tmp_path, "in5"), "k", late="1 second"), "counted", spark, tmp_path).collect()
    assert [(r.n) for r in sorted(got, key=lambda r: r.start)][:2] == [5, 5]


def test_index_follows_stream(spark, tmp_path):
    df = spark.createDataFrame([("p", "old", 0), ("q", "q", 0), ("p", "new", 1)], "path string, chunk_text string, part int")
    out = f"file://{tmp_path}/idx"
    detectors.keep_index(as_stream(spark, df, tmp_path, "in6"), out, f"{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, LogIndex(spark, out).read().collect())) == [("p", "new"), ("q", "q")]


def test_deletions_reach_the_index(spark, tmp_path):
    df = spark.createDataFrame([("p", "1", False, 1, 0), ("q", "q", False, 1, 0), ("r", "r", False, 1, 0), ("p", None, True, 2, 1), ("q", None, True, 2, 1), ("q", "again", False, 3, 1)], "path string, chunk_text string, gone boolean, at int, part int")
    out = f"file://{tmp_path}/idx2"
    detectors.keep_index(as_stream(spark, df, tmp_path, "in8"), out, f"{tmp_path}/cp8", version="at", deleted="gone").awaitTermination()
    assert sorted(map(tuple, LogIndex(spark, out).read().select("path", "chunk_text").collect())) == [("q", "again"), ("r", "r")]


def test_monitor_swallows_and_counts_errors(spark, tmp_path):
    from tessella.streaming.monitor import Monitor

    df = spark.createDataFrame([("a", 95.0, 0), ("b", 10.0, 0), ("c", 99.0, 1)], "k string, v double, part int")
    seen = []
    m = Monitor({"high": lambda b: b.where("v > 90"), "broken": lambda b: b.select("nothing")}, lambda rows, _: seen.extend(tuple(r) for r in rows.collect()))
    m.start(as_stream(spark, df, tmp_path, "in7"), f"{tmp_path}/cp7").awaitTermination()
    assert sorted((r[0], r[2]) for r in seen) == [("a", "high"), ("c", "high")]
    assert m.cycles == 2 and m.errors == {"broken": 2} and m.error_rate == 1.0
