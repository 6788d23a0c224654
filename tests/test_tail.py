import json

from tessella.sources import tail


def take(df, at, name):
    """What a query that starts (again) at this checkpoint finds."""
    out = f"{at}/out-{name}"
    df.writeStream.format("parquet").option("checkpointLocation", f"{at}/cp-{name}").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return out


def values(spark, at):
    return sorted(r.value for r in spark.read.parquet(at).collect())


def lines(spark, folder, **options):
    tail.register(spark)
    return spark.readStream.format("tessella_tail").options(**options).load(str(folder))


def test_a_restart_neither_repeats_nor_loses(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    one, two = folder / "one.log", folder / "two.log"
    one.write_text("a\nb\nhalf")
    out = take(lines(spark, folder), tmp_path, "r")
    assert values(spark, out) == ["a", "b"]
    with one.open("a") as f:
        f.write(" done\n\nc\n")
    two.write_text("x\n")
    take(lines(spark, folder), tmp_path, "r")
    assert values(spark, out) == ["", "a", "b", "c", "half done", "x"]
    take(lines(spark, folder), tmp_path, "r")
    assert values(spark, out) == ["", "a", "b", "c", "half done", "x"]
    # written anew, and one gone
    one.write_text("new\n")
    two.unlink()
    take(lines(spark, folder), tmp_path, "r")
    assert values(spark, out) == ["", "a", "b", "c", "half done", "new", "x"]


def test_a_backlog_is_read_in_parts(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    texts = ["x" * (k % 97) + f"é{k}" for k in range(2000)] + ["y" * 5000]
    (folder / "big.log").write_text("\n".join(texts) + "\n")
    out = take(lines(spark, folder, part="1000"), tmp_path, "p")
    assert values(spark, out) == sorted(texts)
    rows = spark.read.parquet(out).orderBy("at").collect()
    at = 0
    for r, t in zip(rows, texts, strict=True):
        assert (r.at, r.value) == (at, t)
        at += len(t.encode()) + 1


def test_bounded_batches_and_start_at_the_end(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    texts = [f"line {k}" for k in range(300)] + ["z" * 900]
    at = folder / "a.log"
    at.write_text("\n".join(texts) + "\n")
    tail_ = tail.Tail(f"file://{folder}", {"most": "500"})
    before, taken = tail_.initialOffset(), []
    while (now := tail_.latestOffset()) != before:
        for part in tail_.partitions(before, now):
            assert part.end - part.start <= 501 or part.end == at.stat().st_size
            taken += [v for b in tail_.read(part) for v in b.column(2).to_pylist()]
        before = now
    assert taken == texts
    late = tail.Tail(f"file://{folder}", {"start": "last"})
    start = late.initialOffset()
    with at.open("a") as f:
        f.write("later\n")
    assert [v for p in late.partitions(start, late.latestOffset()) for b in late.read(p) for v in b.column(2).to_pylist()] == ["later"]


def test_journal(spark, tmp_path):
    folder = tmp_path / "journal"
    folder.mkdir()
    entries = [
        {"_SYSTEMD_UNIT": "a.service", "MESSAGE": "up", "PRIORITY": "3", "__REALTIME_TIMESTAMP": "1"},
        {"_SYSTEMD_UNIT": "b.service", "MESSAGE": "other"},
        {"_SYSTEMD_UNIT": "a.service", "MESSAGE": [104, 195, 169, 255]},
        {"MESSAGE": None},
    ]
    (folder / "j.json").write_text("".join(json.dumps(e) + "\n" for e in entries))
    got = sorted(map(tuple, spark.read.parquet(take(tail.journal_stream(spark, str(folder), ["a.service"]), tmp_path, "j")).collect()))
    assert got == [("a.service", "hé�", 6, ""), ("a.service", "up", 3, "1")]
    all_ = spark.read.parquet(take(tail.journal_stream(spark, str(folder)), tmp_path, "k")).collect()
    assert sorted((r.unit, r.message) for r in all_)[-1] == ("unknown", "")
