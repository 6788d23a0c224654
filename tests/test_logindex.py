import pytest
from pyspark.sql import functions as F

from tessella.operators.logindex import LogIndex


class Died(Exception):
    pass


@pytest.fixture
def index(spark, tmp_path):
    return LogIndex(spark, f"file://{tmp_path}/index", buckets=8)


def rows(spark, *xs):
    return spark.createDataFrame(list(xs), "path string, v int")


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replaces_removes_and_compacts(spark, index):
    assert index.read() is None and index.remove(rows(spark, ("a", 1))) == 0
    index.upsert(rows(spark, ("a", 1), ("a", 2), ("b", 1), (None, 7)))
    index.upsert(rows(spark, ("b", 5), ("c", 6)))
    assert values(index.read()) == values(rows(spark, ("a", 1), ("a", 2), ("b", 5), ("c", 6), (None, 7)))
    index.upsert(rows(spark, ("c", 8), (None, 9)), rows(spark, ("a", 0), ("c", 0)))
    index.remove(rows(spark, ("b", 0), ("unknown", 0)))
    left = values(rows(spark, ("c", 8), (None, 9)))
    assert values(index.read()) == left
    assert index.compact() == 5 and values(index.read()) == left
    assert max(len(s) for s in index.manifest()["segments"].values()) == 1 and index.compact() == 5
    assert values(index.read(1)) == values(rows(spark, ("a", 1), ("a", 2), ("b", 1), (None, 7)))
    assert values(index.read(keys=["c"])) == [("c", 8)] and index.read(keys=["zz"]).count() == 0


def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    index = LogIndex(spark, f"file://{tmp_path}/index", buckets=64)
    index.upsert(spark.range(2000).select(F.concat(F.lit("p"), "id").alias("path"), F.col("id").cast("int").alias("v")))
    before = index.manifest()["segments"]
    assert len(before) == 64
    ten = rows(spark, *[(f"p{i}", -1) for i in range(10)])
    index.upsert(ten)
    touched = {str(r[0]) for r in ten.select(F.pmod(F.xxhash64("path"), F.lit(64))).distinct().collect()}
    after = index.manifest()["segments"]
    assert {k for k in after if after[k] != before[k]} == touched and len(touched) <= 10
    run = after[min(touched)][-1]["run"]
    assert {p.name.split("=")[1] for p in (tmp_path / "index" / "data" / run).glob("__bucket=*")} == touched
    got = index.read()
    assert got.count() == 2000 and got.where("v = -1").count() == 10


@pytest.mark.parametrize("step", ["write", "create", "done"])
@pytest.mark.parametrize("job", ["upsert", "compact"])
def test_a_writer_may_die_anywhere(spark, index, monkeypatch, step, job):
    """Before and after its rows are written, and after its version is made; a reader beside it sees the old version or the new one."""
    index.upsert(rows(spark, ("a", 1), ("b", 1)))
    index.upsert(rows(spark, ("a", 2)))
    pinned = index.read()
    writer = LogIndex(spark, index.root, buckets=8)
    name = {"write": "_write", "create": "_create", "done": "_create"}[step]
    real = getattr(writer, name)

    def dies(*a):
        if step == "done":
            real(*a)
        raise Died

    monkeypatch.setattr(writer, name, dies)
    with pytest.raises(Died):
        writer.upsert(rows(spark, ("a", 3), ("c", 3))) if job == "upsert" else writer.compact()
    old, new = [("a", 2), ("b", 1)], [("a", 3), ("b", 1), ("c", 3)]
    assert values(index.read()) == (new if job == "upsert" and step == "done" else old)
    assert values(pinned) == old
    index.upsert(rows(spark, ("a", 3), ("c", 3)))
    index.compact()
    index.vacuum(keep=1, hours=0)
    assert values(index.read()) == new


def test_writers_that_race(spark, index, monkeypatch):
    """Both take the same number; the one that loses adds to the winner's version. A compaction keeps what came meanwhile, and gives way to another one."""
    index.upsert(rows(spark, ("a", 1), ("b", 1)))
    index.upsert(rows(spark, ("b", 2)))
    slow, real, once = LogIndex(spark, index.root, buckets=8), index._create, []

    def meanwhile(job):
        def create(*a):
            if not once:
                once.append(1)
                job()
            return real(*a)

        once.clear()
        monkeypatch.setattr(slow, "_create", create)

    meanwhile(lambda: index.upsert(rows(spark, ("b", 3), ("d", 3))))
    assert slow.upsert(rows(spark, ("c", 4))) == 4
    assert values(index.read()) == [("a", 1), ("b", 3), ("c", 4), ("d", 3)]
    meanwhile(lambda: index.upsert(rows(spark, ("a", 9))))
    slow.compact()
    assert values(index.read()) == [("a", 9), ("b", 3), ("c", 4), ("d", 3)]
    index.upsert(rows(spark, ("b", 5)))
    meanwhile(index.compact)
    assert slow.compact() == index.versions()[-1]
    assert values(index.read()) == [("a", 9), ("b", 5), ("c", 4), ("d", 3)]


def test_vacuum_keeps_what_versions_name(spark, index, tmp_path):
    index.upsert(rows(spark, *[(f"p{i}", 0) for i in range(50)]))
    for k in range(3):
        index.upsert(rows(spark, ("p1", k)))
    index.compact()
    held = index.read(4)
    index.vacuum(keep=2, hours=24)
    assert len(list((tmp_path / "index" / "data").iterdir())) == 5  # too young
    index.vacuum(keep=2, hours=0)
    assert index.versions() == [4, 5] and held.where("v = 2").count() == 1 and index.read().count() == 50
    index.vacuum(keep=1, hours=0)
    assert index.read().count() == 50 and len(list((tmp_path / "index" / "data").iterdir())) == 2


def test_repeated_batches_do_no_harm(spark, index):
    index.upsert(rows(spark, ("a", 1)), batch=("stream", 0))
    index.upsert(rows(spark, ("a", 2)), batch=("stream", 1))
    assert index.upsert(rows(spark, ("a", 1)), batch=("stream", 0)) == 2
    assert values(index.read()) == [("a", 2)] and index.upsert(rows(spark, ("a", 3)), batch=("other", 0)) == 3
