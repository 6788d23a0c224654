"""A listing of files as a data source: walks folders in parallel, never enters pruned ones, takes filters; and what changed between listings.

`spark.read.format("tessella_listing").load(root)` gives (path, name, size_bytes, mtime_ns, scanned_at). The driver opens folders until
there are enough of them for all tasks, each task walks its own ones to the end. As a stream, each micro-batch is a new listing.
Any file system that Arrow opens will do (local, HDFS, S3, ...). Options: `tasks`, folders to walk apart at least (64);
`every`, the least seconds between two listings of a stream (600).

Folders of the ignored names are never listed. Filters on `size_bytes` and on `name` or `path` (equal, in, ends with) are pushed into the walk.
"""

from __future__ import annotations

import datetime as dt
import operator
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.operators.filters import IGNORED_DIRS

SCHEMA = "path string, name string, size_bytes long, mtime_ns long, scanned_at timestamp"
COMPARE = {GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, EqualTo: operator.eq}


@dataclass
class Folders(InputPartition):
    """Folders to list, to the end (`deep`) or only their own files."""

    at: list[str]
    deep: bool
    scanned_at: dt.datetime


def accepted(f: Filter) -> bool:
    """Whether the walk can apply a filter itself."""
    if len(getattr(f, "attribute", ())) != 1:
        return False
    column = f.attribute[0]
    if column == "size_bytes":
        return type(f) in COMPARE
    return column in ("name", "path") and isinstance(f, EqualTo | In | StringEndsWith)


def passes(filters: list[Filter], row: dict) -> bool:
    for f in filters:
        v = row[f.attribute[0]]
        ok = v.endswith(f.value) if isinstance(f, StringEndsWith) else v in f.value if isinstance(f, In) else COMPARE[type(f)](v, f.value)
        if not ok:
            return False
    return True


class Walk:
    def __init__(self, root: str, tasks: int, ignored: frozenset[str]) -> None:
        self.root, self.tasks, self.ignored, self.filters = root, tasks, ignored, []

    def _list(self, at: str) -> tuple[list[str], list[pafs.FileInfo]]:
        """Folders to enter, and files, of one folder; one that went meanwhile is empty."""
        infos = self.fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        return [x.path for x in infos if x.type == pafs.FileType.Directory and x.base_name not in self.ignored], [x for x in infos if x.type == pafs.FileType.File]

    @property
    def fs(self) -> pafs.FileSystem:
        return pafs.FileSystem.from_uri(self.root)[0]

    def partitions(self) -> list[Folders]:
        now, (_, top) = dt.datetime.now(), pafs.FileSystem.from_uri(self.root)
        opened, waiting = [], [top]
        # breadth first; a folder that was opened here is listed once more, for its files only
        while waiting and len(waiting) < self.tasks:
            at = waiting.pop(0)
            opened.append(at)
            waiting += self._list(at)[0]
        dealt = [waiting[i :: self.tasks] for i in range(min(self.tasks, len(waiting)))]
        return [Folders(opened, False, now), *[Folders(x, True, now) for x in dealt]]

    def rows(self, part: Folders) -> Iterator[tuple]:
        waiting = list(part.at)
        while waiting:
            folders, files = self._list(waiting.pop())
            if part.deep:
                waiting += folders
            for x in files:
                row = {"path": x.path, "name": x.base_name, "size_bytes": x.size, "mtime_ns": x.mtime_ns or 0}
                if passes(self.filters, row):
                    yield (*row.values(), part.scanned_at)


class ListingReader(DataSourceReader):
    def __init__(self, walk: Walk) -> None:
        self.walk = walk

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if accepted(f):
                self.walk.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Folders]:
        return self.walk.partitions()

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.walk.rows(partition)


class ListingStream(DataSourceStreamReader):
    """Offsets are numbers of listings and when they were begun."""

    def __init__(self, walk: Walk, every: float) -> None:
        self.walk, self.every, self.last = walk, every, {"listing": 0, "at": 0.0}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0, "at": 0.0}

    def latestOffset(self) -> dict:  # noqa: N802
        if time.time() - self.last["at"] >= self.every:
            self.last = {"listing": self.last["listing"] + 1, "at": time.time()}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        self.last = max(self.last, end, key=lambda x: x["listing"])
        return self.walk.partitions() if end["listing"] > start["listing"] else []

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.walk.rows(partition)


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessella_listing"

    def schema(self) -> str:
        return SCHEMA

    def _walk(self) -> Walk:
        root = self.options["path"]
        ignored = frozenset(self.options["ignored"].split(",")) if "ignored" in self.options else frozenset(IGNORED_DIRS)
        return Walk(root if ":" in root else f"file://{root}", int(self.options.get("tasks", "64")), ignored)

    def reader(self, schema) -> ListingReader:
        return ListingReader(self._walk())

    def streamReader(self, schema) -> ListingStream:  # noqa: N802
        return ListingStream(self._walk(), float(self.options.get("every", "600")))


def register(spark: SparkSession) -> None:
    """Makes the format known, and has filters given to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)


CHANGES = "path string, kind string, size_bytes long, mtime_ns long, at timestamp"


class Changes(StatefulProcessor):
    """State of a path: size, time of change, and when it was last seen. A timer for each path fires when it was not seen for a while."""

    def __init__(self, patience_ms: int) -> None:
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "size_bytes long, mtime_ns long, at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("scanned_at")
        out = []
        old = tuple(self.seen.get()) if self.seen.exists() else None
        for size, mtime, at in zip(new["size_bytes"].tolist(), new["mtime_ns"].tolist(), new["scanned_at"], strict=True):
            if old is not None and at < pd.Timestamp(old[2]):
                continue  # an older listing came late
            if old is None or (size, mtime) != tuple(old[:2]):
                out.append((key[0], "created" if old is None else "modified", size, mtime, at))
            old = (size, mtime, at)
        self.seen.update((old[0], old[1], pd.Timestamp(old[2]).to_pydatetime()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(old[2]).value // 1_000_000) + self.patience)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.seen.exists():
            size, mtime, at = self.seen.get()
            self.seen.clear()
            yield self._frame([(key[0], "deleted", size, mtime, pd.Timestamp(at) + pd.Timedelta(milliseconds=self.patience))])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["path", "kind", "size_bytes", "mtime_ns", "at"]).astype({"size_bytes": "int64", "mtime_ns": "int64", "at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def changes(listings: DataFrame, patience: float = 900, late: str = "0 seconds") -> DataFrame:
    """From a stream of listings (path, size_bytes, mtime_ns, scanned_at): a row for each path that is created, modified (its size or time differ), or
    deleted (`patience` seconds of listings passed without it, and `at` is when they had passed; a path that comes back is created anew).

    Needs the RocksDB state store: `spark.sql.streaming.stateStore.providerClass`."""
    source = listings.select("path", "size_bytes", "mtime_ns", "scanned_at").withWatermark("scanned_at", late)
    return source.groupBy("path").transformWithStateInPandas(Changes(int(patience * 1000)), CHANGES, "Append", "EventTime")
