"""Detectors that need rows in order of time, as streams: trailing rates, runs above a threshold, trends, new members.

Rows may come in any order within `late`. Each key holds the rows that the watermark has not passed yet, and one timer wakes it
when it passes the first of them; what is due is then folded in order of time and id into a small state. So results don't depend on
how rows fall into micro-batches, and equal those of `tessella.operators.detect` on the same rows. Rows later than `late` are left
out by Spark, rows without a time here. A null or NaN value counts as not above a threshold.

With `idle` (seconds), a key that had no row for so long is forgotten; else it is kept.

All need the RocksDB state store: `spark.sql.streaming.stateStore.providerClass`.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A row that waits: its time in microseconds, its id and what the fold looks at.
Row = tuple


def _plain(x):
    """A value as the state store takes it."""
    if isinstance(x, np.ndarray):
        return x.tolist()
    return None if isinstance(x, float) and np.isnan(x) else x


class InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them, then folds them in order: fold(state or None, rows) gives the next state and rows (id, time, ...)."""

    def __init__(self, fold: Callable, row: str, state: str, columns: list[str], idle_ms: int | None) -> None:
        self.fold, self.row, self.kind, self.columns, self.idle = fold, row, state, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.state = handle.getValueState("state", self.kind)
        self.newest = handle.getValueState("newest", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(at), _plain(i), _plain(x)) for part in rows for at, i, x in zip(part["at__"].tolist(), part["id__"].tolist(), part["item__"].tolist(), strict=True)]
        self.waiting.appendList(new)
        self._wake(min(at for at, _, _ in new))
        return iter(())

    def _wake(self, at_us: int, fired: int | None = None) -> None:
        """One timer at most, for the first row that waits. The one that fired just now is still listed, but goes by itself."""
        at = -(-at_us // 1000)
        set_ = [t for t in self.handle.listTimers() if t != fired]
        if not set_ or at < min(set_):
            for t in set_:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def _runs(self, due: list[Row]) -> Iterator[list[Row]]:
        """Rows parted where the key was idle, so that it doesn't matter when the timer that forgets it fires."""
        run: list[Row] = []
        for x in due:
            if run and self.idle is not None and x[0] - run[-1][0] > self.idle * 1000:
                yield run
                run = []
            run.append(x)
        yield run

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, fired = timerValues.getCurrentWatermarkInMs() * 1000, expiredTimerInfo.getExpiryTimeInMs()
        held: dict[bool, list[Row]] = {True: [], False: []}
        for x in self.waiting.get():
            held[x[0] <= mark].append(tuple(x))
        due, later = held[True], held[False]
        if due:
            due.sort(key=lambda x: (x[0], x[1] is not None, x[1]))
            state, newest, out = (tuple(self.state.get()), self.newest.get()[0], []) if self.state.exists() else (None, due[0][0], [])
            for rows in self._runs(due):
                idle = self.idle is not None and rows[0][0] - newest > self.idle * 1000
                state, made = self.fold(None if idle else state, rows)
                newest = rows[-1][0]
                out += made
            self.state.update(state)
            self.newest.update((newest,))
            if out:
                yield pd.DataFrame([(*key, *x) for x in out], columns=self.columns)
        if later:
            self.waiting.put(later)
            self._wake(min(x[0] for x in later), fired)
            return
        self.waiting.clear()
        if self.idle is not None and self.newest.exists():
            last = self.newest.get()[0] + self.idle * 1000
            if mark > last:
                self.state.clear()
                self.newest.clear()
            else:
                self._wake(last + 1000, fired)

    def close(self) -> None:
        pass


def _run(events: DataFrame, by: list[str], ts: str, id_: str, item: str | None, fold: Callable, state: str, made: dict[str, str], late: str, idle: float | None) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    own = F.col(item) if item else F.lit(None).cast("int")
    source = events.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    source = source.select(*by, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at__"), F.col(id_).alias("id__"), own.alias("item__"))
    columns = [*by, id_, "at__", *made]
    schema = ", ".join(f"`{c}` {k}" for c, k in zip(columns, [*[kinds[c] for c in by], kinds[id_], "bigint", *made.values()], strict=True))
    row = f"at bigint, id {kinds[id_]}, item {kinds[item] if item else 'int'}"
    processor = InOrder(fold, row, state, columns, None if idle is None else int(idle * 1000))
    out = source.groupBy(*by).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return out.select(*by, id_, F.timestamp_micros("at__").alias(ts), *made)


def _rates(span: int, most: int, state: tuple | None, rows: list[Row]) -> tuple:
    held, out = list(state[0]) if state else [], []
    for at, same in groupby(rows, key=lambda x: x[0]):
        ids = [x[1] for x in same]
        held = (held[bisect_right(held, at - span) :] + [at] * len(ids))[-most:]
        minutes = (held[-1] - held[0]) / 60e6
        rate = len(held) / minutes if len(held) > 1 and minutes else 0.0
        out += [(i, at, rate) for i in ids]
    return (held,), out


def rates(events: DataFrame, by: list[str], ts: str, id_: str, seconds: int = 300, most: int = 1000, late: str = "10 seconds", idle: float | None = None) -> DataFrame:
    """Each row with the rate over the window that ends with it, as `detect.rate_per_minute`. State: the times in the window, `most` at most."""
    return _run(events, by, ts, id_, None, partial(_rates, seconds * 1_000_000, most), "held array<bigint>", {"rate": "double"}, late, idle)


def _sustained(threshold: float, seconds: float, state: tuple | None, rows: list[Row]) -> tuple:
    start, out = state[0] if state else None, []
    for at, i, value in rows:
        if value is None or value <= threshold:
            start = None
            continue
        start = at if start is None else start
        if (at - start) / 1e6 > seconds:
            out.append((i, at, float(value), (at - start) / 1e6))
    return (start,), out


def sustained(events: DataFrame, value: str, by: list[str], ts: str, id_: str, threshold: float, seconds: float = 60, late: str = "10 seconds", idle: float | None = None) -> DataFrame:
    """Rows of runs above the threshold once the run has lasted more than `seconds`, as `detect.sustained`. State: when the run began."""
    events = events.withColumn(value, F.col(value).cast("double"))
    return _run(events, by, ts, id_, value, partial(_sustained, threshold, seconds), "start bigint", {value: "double", "sustained_sec": "double"}, late, idle)


def _eta(threshold: float, least: int, recent: int, history: int, state: tuple | None, rows: list[Row]) -> tuple:
    n, ats, values = (state[0], list(state[1]), list(state[2])) if state else (0, [], [])
    out = []
    for at, i, value in rows:
        n, ats, values = min(n + 1, history), [*ats, at][-recent:], [*values, value][-recent:]
        span, first, eta = (at - ats[0]) / 1e6, values[0], None
        slope = (value - first) / span if span and value is not None and first is not None else 0.0
        if n >= least and slope > 0:
            eta = max(threshold - value, 0.0) / slope
        out.append((i, at, value, eta))
    return (n, ats, values), out


def time_to_threshold(events: DataFrame, value: str, by: list[str], ts: str, id_: str, threshold: float, least: int = 10, recent: int = 30, history: int = 360, late: str = "10 seconds", idle: float | None = None) -> DataFrame:
    """Each row with the seconds until the line through the first and last of the recent rows meets the threshold, as `detect.time_to_threshold`. State: the recent rows."""
    events = events.withColumn(value, F.col(value).cast("double"))
    fold = partial(_eta, threshold, least, recent, history)
    return _run(events, by, ts, id_, value, fold, "n int, ats array<bigint>, held array<double>", {value: "double", "eta": "double"}, late, idle)


def _added(expected: list, state: tuple | None, rows: list[Row]) -> tuple:
    before, out = list(state[0]) if state and state[0] is not None else None, []
    for at, i, members in rows:
        added = [] if before is None else None if members is None else sorted(set(members) - set(before) - set(expected))
        out.append((i, at, added))
        before = members
    return (before,), out


def new_members(events: DataFrame, members: str, by: list[str], ts: str, id_: str, expected: list, late: str = "10 seconds", idle: float | None = None) -> DataFrame:
    """Each row with `added`: members that neither the row before nor `expected` has, as `detect.new_members`. State: the members of the row before."""
    kind = dict(events.dtypes)[members]
    return _run(events, by, ts, id_, members, partial(_added, expected), f"members {kind}", {"added": kind}, late, idle)
