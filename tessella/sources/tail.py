"""Lines of growing files as a stream with a position, and the journal read that way.

`spark.readStream.format("tessella_tail").load(folder)` gives (file, at, value): each line once, and the byte where it begins. An offset is
the length of each file up to its last whole line, so a query that starts again goes on behind what it has committed, and a line that
is still being written waits until it ends. A backlog is read in parts of `part` bytes (64 MiB), by all tasks. A file that became
shorter was written anew and is read from its start; one that is gone is forgotten.

Options: `start`, `first` (default) for all that is there, `last` for what is written after the query first starts; `suffix`; `part`;
`most`, the bytes that one micro-batch takes of each file (all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessella.sources.system import journal

BLOCK = 1 << 20


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin at `start` or after it, and before `end`."""

    file: str
    start: int
    end: int


class Tail(DataSourceStreamReader):
    def __init__(self, root: str, options: dict) -> None:
        self.root, self.suffix, self.first = root, options.get("suffix", ""), options.get("start", "first") == "first"
        self.part, self.most = int(options.get("part", 64 << 20)), int(options.get("most", 1 << 62))
        self.known: dict[str, int] | None = None

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.root)

    def _whole(self, fs: pafs.FileSystem, file: str, size: int, least: int) -> int:
        """The length of a file's whole lines, looked for backward from `size`."""
        with fs.open_input_file(file) as f:
            end = size
            while end > least:
                start = max(least, end - BLOCK)
                at = f.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return least

    def _lengths(self, before: dict[str, int]) -> dict[str, int]:
        fs, at = self._open()
        infos = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
        out = {}
        for x in infos:
            if x.type == pafs.FileType.File and x.base_name.endswith(self.suffix):
                old = before.get(x.path, 0)
                start = old if old <= x.size else 0
                whole = start if x.size == start else self._whole(fs, x.path, x.size, start)
                if whole - start > self.most:
                    # a line longer than `most` is taken whole
                    whole = self._whole(fs, x.path, start + self.most, start) if self.most else whole
                    whole = whole if whole > start else self._next(fs, x.path, start + self.most)
                out[x.path] = whole
        return out

    def _next(self, fs: pafs.FileSystem, file: str, start: int) -> int:
        """Where the line ends that holds the byte before `start`."""
        with fs.open_input_file(file) as f:
            while block := f.read_at(BLOCK, start):
                at = block.find(b"\n")
                if at >= 0:
                    return start + at + 1
                start += len(block)
        return start

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {} if self.first else self._lengths({})}

    def latestOffset(self) -> dict:  # noqa: N802
        self.known = self._lengths(self.known or {})
        return {"files": self.known}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.known = dict(end["files"])
        out = []
        for file, stop in end["files"].items():
            begin = start["files"].get(file, 0)
            begin = begin if begin <= stop else 0
            out += [Stretch(file, at, min(at + self.part, stop)) for at in range(begin, stop, self.part)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        fs, _ = self._open()
        names = ["file", "at", "value"]
        with fs.open_input_file(partition.file) as f:
            at = partition.start if partition.start == 0 else self._next(fs, partition.file, partition.start - 1)
            while at < partition.end:
                # whole lines of a block; the last one that begins before the end may reach over it
                stop = self._whole(fs, partition.file, min(at + BLOCK, partition.end), at)
                stop = stop if stop > at else self._next(fs, partition.file, min(at + BLOCK, partition.end))
                lines = f.read_at(stop - at, at).split(b"\n")[:-1]
                starts = [at]
                for line in lines[:-1]:
                    starts.append(starts[-1] + len(line) + 1)
                texts = [line.decode("utf-8", "replace") for line in lines]
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines), pa.string()), pa.array(starts, pa.int64()), pa.array(texts, pa.string())], names=names)
                at = stop


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessella_tail"

    def schema(self) -> str:
        return "file string, at bigint, value string"

    def streamReader(self, schema) -> Tail:  # noqa: N802
        root = self.options["path"]
        return Tail(root if ":" in root else f"file://{root}", dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)


def journal_stream(spark: SparkSession, folder: str, units: list[str] | None = None, **options: str) -> DataFrame:
    """Journal entries as they are written to the files of `folder`, exports of the journal as lines of JSON; with `units`, only theirs."""
    register(spark)
    lines = spark.readStream.format("tessella_tail").options(**options).load(folder)
    rows = journal(lines.where(F.trim("value") != ""))
    return rows.where(F.col("unit").isin(units)) if units else rows
