"""A log-structured index table: rows by path in hash buckets, of which a writer adds only those that it touches.

Under the root, `data/<run>/__bucket=<k>` holds what one writer wrote, and `_manifest/<version>.json` names, for each bucket, its
segments from old to new. A version exists once its manifest does: it is written beside and then renamed to its number,
which fails if that number is taken (`FileContext.rename` without overwriting, atomic on HDFS and local disks). Whoever loses that race
takes the newest manifest and adds its segments to that; a writer that dies before leaves folders that no manifest names.

In a segment, the rows of a path replace all older ones of the path, and a row marked as gone removes them. Readers are pinned to a version:
what it names is never changed, and `vacuum` deletes only what no kept version names. Buckets with one segment are read as they are; only
others are merged, by path. `compact` makes one segment of several.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GONE, BUCKET, AT = "__gone", "__bucket", "__at"


class LogIndex:
    """The index in folder `root`. Key and number of buckets are those of its first version."""

    def __init__(self, spark: SparkSession, root: str, key: str = "path", buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    # Files

    def _path(self, at: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, at: str) -> list[tuple[str, int]]:
        """Names in a folder, and when they were last changed, in milliseconds."""
        path, fs = self._path(at)
        return [(x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, at: str) -> None:
        path, fs = self._path(at)
        fs.delete(path, True)

    def _create(self, at: str, text: str) -> bool:
        """Makes a file with this text, unless there is one: False then."""
        (new, fs), (path, _) = self._path(f"_manifest/.{uuid.uuid4().hex}"), self._path(at)
        out = fs.create(new)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        how = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, path, how)
        except Exception as e:
            fs.delete(new, False)
            if fs.exists(path):
                return False
            raise RuntimeError(f"can't write {self.root}/{at}") from e
        return True

    # Versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self._list("_manifest") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version, or the newest one, is made of; version 0 is empty."""
        known = self.versions()
        version = version if version is not None else known[-1] if known else 0
        if version == 0:
            return {"version": 0, "key": self.key, "buckets": self.buckets, "schema": None, "segments": {}, "batches": {}}
        path, fs = self._path(f"_manifest/{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change) -> int:
        """Applies change(manifest), which may raise or return None for nothing to do, to the newest version until that is still the newest one."""
        while True:
            old = self.manifest()
            new = change(json.loads(json.dumps(old)))
            if new is None:
                return old["version"]
            new["version"] = old["version"] + 1
            if self._create(f"_manifest/{new['version']:012d}.json", json.dumps(new)):
                return new["version"]

    # Writing

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, list[str]]:
        """The run and buckets of rows with GONE, written."""
        run = uuid.uuid4().hex
        dealt = rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(buckets)))
        dealt.repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.root}/data/{run}")
        return run, [n.split("=")[1] for n, _ in self._list(f"data/{run}") if n.startswith(f"{BUCKET}=")]

    def upsert(self, rows: DataFrame, paths: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """Replaces all rows of the rows' paths, and of `paths`, which may have no rows any more. Writes only the buckets of these.

        batch: a writer's name and the number of its batch; a batch that a version has already is left out, so a repeated one does no harm."""
        at = self.manifest()
        if batch and at["batches"].get(batch[0], -1) >= batch[1]:
            return at["version"]
        schema = rows.schema if at["schema"] is None else T.StructType.fromJson(at["schema"])
        own = rows.select(*schema.names).withColumn(GONE, F.lit(False))
        if paths is not None:
            there = rows.select(F.col(self.key).alias("__there")).distinct()
            gone = paths.select(self.key).distinct().join(there, F.col(self.key).eqNullSafe(F.col("__there")), "left_anti")
            own = own.unionByName(gone.withColumn(GONE, F.lit(True)), allowMissingColumns=True)
        run, touched = self._write(own, at["buckets"])

        def change(m: dict) -> dict | None:
            if batch and m["batches"].get(batch[0], -1) >= batch[1]:
                return None
            if m["schema"] is None:
                m["schema"] = json.loads(T.StructType([T.StructField(f.name, f.dataType) for f in schema]).json())
            for k in touched:
                m["segments"].setdefault(k, []).append({"run": run, "at": m["version"] + 1})
            if batch:
                m["batches"][batch[0]] = batch[1]
            return m

        return self._commit(change)

    def remove(self, paths: DataFrame) -> int:
        """Removes all rows of these paths; unknown ones do no harm."""
        m = self.manifest()
        if m["schema"] is None:
            return 0
        return self.upsert(self.spark.createDataFrame([], T.StructType.fromJson(m["schema"])), paths)

    def compact(self, most: int = 1) -> int:
        """One segment for each bucket that has more than `most`; what others add meanwhile stays after it."""
        at = self.manifest()
        many = {k: s for k, s in at["segments"].items() if len(s) > most}
        if not many:
            return at["version"]
        run, left = self._write(self._rows(at, many).withColumn(GONE, F.lit(False)), at["buckets"])

        def change(m: dict) -> dict | None:
            for k, read in many.items():
                if m["segments"].get(k, [])[: len(read)] != read:
                    return None  # compacted by another writer
                one = [{"run": run, "at": read[-1]["at"]}] if k in left else []
                m["segments"][k] = one + m["segments"][k][len(read) :]
            m["segments"] = {k: s for k, s in m["segments"].items() if s}
            return m

        return self._commit(change)

    def vacuum(self, keep: int = 2, hours: float = 24) -> None:
        """Deletes all but the newest `keep` versions, and folders that no version left names, if they are older than `hours`: younger ones may belong to a writer at work."""
        known = self.versions()
        left = [self.manifest(v) for v in known[-keep:]]
        for v in known[:-keep]:
            self._delete(f"_manifest/{v:012d}.json")
        named = {(s["run"], k) for m in left for k, segments in m["segments"].items() for s in segments}
        runs, before = {r for r, _ in named}, time.time() * 1000 - hours * 3.6e6
        for run, changed in self._list("data"):
            if changed > before:
                continue
            if run not in runs:
                self._delete(f"data/{run}")
                continue
            for name, _ in self._list(f"data/{run}"):
                if name.startswith(f"{BUCKET}=") and (run, name.split("=")[1]) not in named:
                    self._delete(f"data/{run}/{name}")

    # Reading

    def _rows(self, m: dict, segments: dict[str, list]) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        whole = T.StructType([*schema.fields, T.StructField(GONE, T.BooleanType())])

        def of(parts: list[tuple[str, str]]) -> DataFrame:
            return self.spark.read.schema(whole).parquet(*[f"{self.root}/data/{run}/{BUCKET}={k}" for run, k in parts])

        alone = [(s[0]["run"], k) for k, s in segments.items() if len(s) == 1]
        done = [of(alone)] if alone else []
        runs: dict[tuple[int, str], list[str]] = {}
        for k, s in segments.items():
            for x in s if len(s) > 1 else []:
                runs.setdefault((x["at"], x["run"]), []).append(k)
        if runs:
            both = None
            for (at, run), ks in sorted(runs.items()):
                part = of([(run, k) for k in ks]).withColumn(AT, F.lit(at).cast("long"))
                both = part if both is None else both.unionByName(part)
            last = both.groupBy(F.col(self.key).alias("__last")).agg(F.max(AT).alias("__newest"))
            done.append(both.join(last, F.col(self.key).eqNullSafe(F.col("__last")) & (F.col(AT) == F.col("__newest"))).drop(AT, "__last", "__newest"))
        out = done[0] if len(done) == 1 else done[0].unionByName(done[1])
        return out.where(~F.col(GONE)).drop(GONE)

    def read(self, version: int | None = None, keys: list | None = None) -> DataFrame | None:
        """The rows of a version, or of the newest one; None where nothing was written yet. With `keys` only those paths, and only their buckets are read."""
        m = self.manifest(version)
        if m["schema"] is None:
            return None
        segments = m["segments"]
        if keys is not None:
            own = self.spark.createDataFrame([(k,) for k in keys], f"k {T.StructType.fromJson(m['schema'])[self.key].dataType.simpleString()}")
            wanted = {str(r[0]) for r in own.select(F.pmod(F.xxhash64("k"), F.lit(m["buckets"]))).distinct().collect()}
            segments = {k: s for k, s in segments.items() if k in wanted}
        if not segments:
            return self.spark.createDataFrame([], T.StructType.fromJson(m["schema"]))
        rows = self._rows(m, segments)
        return rows if keys is None else rows.where(F.col(self.key).isin(keys))
