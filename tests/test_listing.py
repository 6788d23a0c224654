import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tessella.sources import listing

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for at in ("a.py", "src/b.py", "src/deep/er/c.md", "src/node_modules/x/d.py", ".git/e.py", "node_modules/f.py", ".github/g.yml", "docs/h.md", "docs/empty.md"):
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / at).write_text("" if "empty" in at else at * 10)
    return root


def found(df, tree):
    return sorted(os.path.relpath(r.path, tree) for r in df.collect())


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_lists_all_but_pruned(spark, tree, tasks):
    listing.register(spark)
    got = spark.read.format("tessella_listing").option("tasks", tasks).load(str(tree))
    assert found(got, tree) == [".github/g.yml", "a.py", "docs/empty.md", "docs/h.md", "src/b.py", "src/deep/er/c.md"]
    r = got.where("name = 'b.py'").first()
    assert (r.size_bytes, r.mtime_ns) == ((tree / "src/b.py").stat().st_size, (tree / "src/b.py").stat().st_mtime_ns)


def test_pruned_folders_are_not_listed(tree):
    walk, listed = listing.Walk(f"file://{tree}", 3, frozenset(["node_modules", ".git"])), []
    real = walk._list
    walk._list = lambda at: (listed.append(os.path.relpath(at, tree)), real(at))[1]
    rows = [r for p in walk.partitions() for r in walk.rows(p)]
    assert len(rows) == 6 and not any("node_modules" in x or x.startswith(".git/") or x == ".git" for x in listed)


def test_filters_reach_the_walk(spark, tree):
    listing.register(spark)
    df = spark.read.format("tessella_listing").load(str(tree))
    assert found(df.where(F.col("name").endswith(".md") & (F.col("size_bytes") > 0)), tree) == ["docs/h.md", "src/deep/er/c.md"]
    assert found(df.where(F.col("name").isin("a.py", "h.md")), tree) == ["a.py", "docs/h.md"]
    from pyspark.sql.datasource import GreaterThan, Not, StringEndsWith

    reader = listing.ListingReader(listing.Walk(f"file://{tree}", 3, frozenset()))
    kept = list(reader.pushFilters([GreaterThan(("size_bytes",), 0), StringEndsWith(("name",), ".md"), Not(GreaterThan(("size_bytes",), 9)), GreaterThan(("mtime_ns",), 0)]))
    assert len(kept) == 2 and len(reader.walk.filters) == 2
    assert sorted(r[1] for p in reader.partitions() for r in reader.read(p)) == ["c.md", "h.md"]


def _rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_changes_of_listings(spark, tmp_path):
    """Created, modified by time and by size, gone and back again; a path that stays gives one row."""
    _rocks(spark)
    scans = [{"a": (1, 1), "b": (1, 1), "c": (1, 1)}, {"a": (1, 2), "c": (1, 1)}, {"a": (5, 2), "c": (1, 1), "d": (1, 1)}, {"c": (1, 1)}, {"b": (1, 1), "c": (1, 1), "d": (1, 1)}, {"c": (1, 1)}]
    at = f"{tmp_path}/scans"
    for n, files in enumerate(scans):
        rows = [(p, s, m, T0 + dt.timedelta(seconds=60 * n)) for p, (s, m) in files.items()]
        spark.createDataFrame(rows, "path string, size_bytes long, mtime_ns long, scanned_at timestamp").coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema("path string, size_bytes long, mtime_ns long, scanned_at timestamp").option("maxFilesPerTrigger", 1).parquet(at)
    q = listing.changes(stream, patience=90).writeStream.format("memory").queryName("changed").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.path, r.at.timestamp() - T0.timestamp(), r.kind) for r in spark.table("changed").collect())
    assert [(p, k) for p, _, k in got if p == "a"] == [("a", "created"), ("a", "modified"), ("a", "modified"), ("a", "deleted")]
    assert [(k) for p, _, k in got if p == "b"][:3] == ["created", "deleted", "created"]
    assert [k for p, _, k in got if p == "c"] == ["created"]
