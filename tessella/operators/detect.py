"""Detectors over ordered rows: rates, baselines, spikes, trends, runs, set changes, limiters.

Each works within a key (`by`) and orders by time, then id, so results don't depend on the order of rows. Baselines (`ewma`,
`baselines`, `spikes`) are parallel scans and rates have a halo of rows about each stretch of time, so a key that holds most rows is
spread over all tasks. `restart_limiter` folds rows that Spark has sorted by key and order (sorts spill), batch by batch, and
carries one small state a key; a streaming form is in `tessella.streaming`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessella.operators.parts import in_parts, prefix_sum, same

#: Ports that may listen without alert.
EXPECTED_PORTS = [22, 53, 80, 443, 631, 5353, 8080]
ALPHA_RATE, ALPHA_RESOURCE = 0.1, 0.2


def _fold(df: DataFrame, by: list[str], order: list[str], item: str, step: Callable, start: Callable, kinds: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """Rows (by, order, item, and what each step gives) with each key's rows in order; step(state, item) gives the next state and the new columns' values."""
    source = df.select(*by, *order, item).repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, *order)
    schema = T.StructType(list(source.schema))
    for name, (kind, _) in kinds.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start()
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            keys = zip(*[batch.column(i).to_pylist() for i in range(len(by))], strict=True)
            for k, x in zip(keys, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if k != key:
                    key, state = k, start()
                state, made = step(state, x)
                for column, v in zip(out, made, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, (_, t) in zip(out, kinds.values(), strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)


def baselines(df: DataFrame, value: str, alpha: float, by: list[str], order: list[str]) -> DataFrame:
    """Each row with the baseline before it (0 for the first) and after it; a baseline of 0 counts as unset, a null value leaves it as it is.

    A parallel scan, so that one key may fill all tasks: a value moves the baseline b to alpha * value + (1 - alpha) * b, so a part of a
    key moves it to p * b + q, or to its own fold where b is unset. The parts' maps are folded in order, a row each, and in a second pass
    each part goes on from the baseline that it starts with. A set baseline can only become unset again where values of both signs
    cancel out; keys that have both are folded row by row in one task each."""
    rows = in_parts(df.select(*by, *order, F.col(value).cast("double").alias(value)), by, order)
    both = rows.groupBy(*by).agg(((F.min(value) < 0) & (F.max(value) > 0)).alias("__both")).where("__both").select(*[F.col(c).alias(f"__{c}") for c in by])
    if both.limit(1).count():
        odd = rows.join(both, same(by, "__"), "left_semi").drop("__part")
        return _scanned(rows.join(both, same(by, "__"), "left_anti"), value, alpha, by, order).unionByName(_folded(odd, value, alpha, by, order))
    return _scanned(rows, value, alpha, by, order)


def _step(alpha: float, before: float, v: float | None) -> float:
    return before if v is None else v if before == 0 else alpha * v + (1 - alpha) * before


def _folded(df: DataFrame, value: str, alpha: float, by: list[str], order: list[str]) -> DataFrame:
    def step(before: float, v: float | None) -> tuple:
        after = _step(alpha, before, v)
        return after, (before, after)

    return _fold(df, by, order, value, step, float, {"before": ("double", pa.float64()), "after": ("double", pa.float64())})


def _scanned(rows: DataFrame, value: str, alpha: float, by: list[str], order: list[str]) -> DataFrame:
    key, n = [*by, "__part"], len(by) + 1
    dealt = rows.repartition(*[F.col(c) for c in key])

    def runs(batches: Iterator[pa.RecordBatch], start: Callable) -> Iterator[tuple]:
        """(batch, row from, row to, whether a new part begins) for each stretch of one part."""
        last = start
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(n)], strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield batch, lo, hi, keys[lo] != last
                last = keys[lo]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [[]] * (n + 3)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=parts.names)

        kinds = None
        for batch, lo, hi, new in runs(batches, None):
            kinds = [batch.schema.field(i).type for i in range(n)] + [pa.float64()] * 3
            if new:
                if len(held) == 1024:
                    yield out()
                    held = []
                held.append((*[batch.column(i)[lo].as_py() for i in range(n)], 1.0, 0.0, 0.0))
            p, q, own = held[-1][n:]
            for v in batch.column(batch.num_columns - 1)[lo:hi].to_pylist():
                own = _step(alpha, own, v)
                if v is not None:
                    p, q = p * (1 - alpha), alpha * v + (1 - alpha) * q
            held[-1] = (*held[-1][:n], p, q, own)
        if held:
            yield out()

    parts = dealt.select(*key).schema.add("p", "double").add("q", "double").add("own", "double")
    source = dealt.sortWithinPartitions(*key, *order).select(*key, *order, value)
    moved = source.mapInArrow(maps, parts).withColumn("map", F.struct("p", "q", "own"))

    def compose(before: float, m: dict) -> tuple:
        return m["own"] if before == 0 else m["p"] * before + m["q"], (before,)

    starts = _fold(moved, by, ["__part"], "map", compose, float, {"start": ("double", pa.float64())}).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__of"), "start")
    whole = rows.join(starts, same(by, "__") & (F.col("__part") == F.col("__of"))).select(*key, *order, "start", value)
    whole = whole.repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key, *order)
    schema = whole.select(*by, *order, value).schema.add("before", "double").add("after", "double")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = 0.0
        for batch, lo, hi, new in runs(batches, None):
            if new:
                b = batch.column(batch.num_columns - 2)[lo].as_py()
            each = list(accumulate(batch.column(batch.num_columns - 1)[lo:hi].to_pylist(), lambda x, v: _step(alpha, x, v), initial=b))
            own = [c.slice(lo, hi - lo) for i, c in enumerate(batch.columns) if i not in (n - 1, batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(each[:-1], pa.float64()), pa.array(each[1:], pa.float64())], names=schema.names)
            b = each[-1]

    return whole.mapInArrow(fill, schema)


def ewma(df: DataFrame, value: str, alpha: float, by: list[str], order: list[str]) -> DataFrame:
    """The last baseline of each key, and how many rows it has."""
    each = baselines(df, value, alpha, by, order)
    return each.groupBy(*by).agg(F.count("*").alias("n"), F.max_by("after", F.struct(*order)).alias("ewma"))


def spikes(df: DataFrame, value: str, by: list[str], order: list[str], threshold: float, alpha: float = ALPHA_RATE) -> DataFrame:
    """Rows whose value exceeds threshold times the baseline before them, where that is set."""
    rows = baselines(df, value, alpha, by, order).where((F.col("before") > 0) & (F.col(value) > F.col("before") * threshold))
    return rows.withColumn("multiplier", F.col(value) / F.col("before")).drop("after")


def rate_per_minute(df: DataFrame, ts: str, by: list[str], seconds: int = 300, most: int = 1000, stretch: int = 2) -> DataFrame:
    """Each row with the rate over the window that ends with it: rows strictly newer than `seconds` ago, the newest `most` at most; 0 below two rows.

    Time is cut into stretches of `stretch` windows, and each has the rows of the window before it as a halo, so that a key is as many
    groups as it has stretches. There, each row also stands a second time where it leaves the window; sums that only grow then give each
    window's count, and the next row to leave its oldest member, so the work doesn't depend on how many rows a window holds."""
    span_us = seconds * 1_000_000
    width = span_us * stretch
    rows = df.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp")))
    # also right before 1970
    rows = rows.withColumn("__own", F.expr(f"(__at - pmod(__at, {width})) div {width}"))
    # the last window of a stretch is the halo of the next one
    late = F.pmod(F.col("__at"), F.lit(width)) >= width - span_us
    rows = rows.withColumn("__cell", F.explode(F.when(late, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    key = [*by, "__cell"]
    order = W.partitionBy(*key).orderBy("__at")
    # rows of the same time count for one another, so what goes back from the last of them holds for all
    rows = rows.withColumn("__newest", F.lag("__at", most - 1).over(order)).withColumn("__newest", F.max("__newest").over(order.rangeBetween(0, 0))).withColumn("__come", F.lit(1))
    gone = rows.select(*key, (F.col("__at") + span_us).alias("__at"), F.lit(-1).alias("__come"))
    both = rows.unionByName(gone, allowMissingColumns=True)
    so_far = W.partitionBy(*key).orderBy("__at").rangeBetween(W.unboundedPreceding, W.currentRow)
    later = W.partitionBy(*key).orderBy(F.desc("__at")).rangeBetween(W.unboundedPreceding, -1)
    leaves = F.last(F.when(F.col("__come") < 0, F.col("__at") - span_us), ignorenulls=True)
    both = both.withColumns({"__n": F.sum("__come").over(so_far), "__oldest": leaves.over(later)})
    done = both.where("__come > 0 AND __cell = __own").withColumns({"__n": F.least("__n", F.lit(most)), "__from": F.greatest("__oldest", "__newest")})
    span = (F.col("__at") - F.col("__from")) / F.lit(60e6)
    rate = F.when((F.col("__n") < 2) | (span == 0), F.lit(0.0)).otherwise(F.col("__n") / span)
    return done.withColumn("rate", rate).select(*df.columns, "rate")


def new_members(df: DataFrame, members: str, by: list[str], order: str, expected: list) -> DataFrame:
    """Rows of (key, time, array of members) with `added`: members that neither the row before nor `expected` has; nothing on the first row."""
    w = W.partitionBy(*by).orderBy(order)
    before = F.lag(members).over(w)
    kind = dict(df.dtypes)[members]
    added = F.array_except(F.array_except(F.col(members), before), F.array(*[F.lit(x) for x in expected]).cast(kind))
    return df.withColumn("added", F.when(before.isNotNull(), F.array_sort(added)).otherwise(F.array().cast(kind)))


def time_to_threshold(df: DataFrame, value: str, ts: str, by: list[str], threshold: float, least: int = 10, recent: int = 30, history: int = 360) -> DataFrame:
    """Each row with `eta`: seconds until the line through the first and last of the recent rows meets the threshold; 0 beyond it, null without a rise or with few rows."""
    df = df.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6))
    order = W.partitionBy(*by).orderBy("__at")
    last, held = order.rowsBetween(-(recent - 1), 0), order.rowsBetween(-(history - 1), 0)
    dt = F.col("__at") - F.first("__at").over(last)
    slope = F.try_divide(F.col(value) - F.first(value).over(last), dt)
    left = F.lit(threshold) - F.col(value)
    eta = F.when(F.count("*").over(held) < least, F.lit(None)).when(F.coalesce(slope, F.lit(0.0)) <= 0, F.lit(None)).when(left <= 0, F.lit(0.0)).otherwise(left / slope)
    return df.withColumn("eta", eta.cast("double")).drop("__at")


def sustained(df: DataFrame, value: str, ts: str, by: list[str], order: list[str], threshold: float, seconds: float = 60) -> DataFrame:
    """Rows of runs above the threshold, once the run has lasted more than `seconds`, with `sustained_sec`."""
    w = W.partitionBy(*by).orderBy(*order)
    run = F.sum(F.when(F.col(value) > threshold, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    high = df.withColumn("__run", run).where(F.col(value) > threshold)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    high = high.withColumn("sustained_sec", (at - F.min(at).over(W.partitionBy(*by, "__run"))) / F.lit(1e6))
    return high.where(F.col("sustained_sec") > seconds).drop("__run")


def restart_limiter(df: DataFrame, ts: str, by: list[str], id_: str, most: int = 5, seconds: float = 60) -> DataFrame:
    """Each attempt with `allowed`: whether fewer than `most` allowed ones lie within `seconds` before it. Attempts that were denied don't count."""
    period = int(seconds * 1_000_000)

    def step(held: list[int], at: int) -> tuple:
        held = [t for t in held if at - t <= period]
        ok = len(held) < most
        return [*held, at] if ok else held, (ok,)

    rows = df.select(*by, F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"), id_).withColumn("__time", F.col("__at"))
    return _fold(rows, by, ["__at", id_], "__time", step, list, {"allowed": ("boolean", pa.bool_())}).select(*by, id_, "allowed")


def last_unseen(df: DataFrame, seen: DataFrame, id_: str, n: int, *order: Column) -> DataFrame:
    """Of the last n rows those whose id was not seen yet."""
    return df.orderBy(*order).limit(n).join(seen.select(id_), id_, "left_anti")


def sessions(df: DataFrame, ts: str, by: list[str], gap: str) -> DataFrame:
    """Runs of events with less than `gap` between neighbours: the batch form of debouncing."""
    return df.groupBy(*by, F.session_window(F.col(ts).cast("timestamp"), gap).alias("s")).agg(F.count("*").alias("n")).select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def reconcile(desired: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """What to do about each key, from desired (key) and actual (key, running, healthy): start, restart, mark degraded, stop or nothing."""
    d = desired.select(key, F.lit(True).alias("__wanted"))
    a = actual.select(key, "running", "healthy", F.lit(True).alias("__there"))
    action = (
        F.when(F.col("__wanted").isNull(), F.lit("stop"))
        .when(F.col("__there").isNull(), F.lit("start"))
        .when(~F.col("running"), F.lit("restart"))
        .when(~F.col("healthy"), F.lit("degraded"))
        .otherwise(F.lit("none"))
    )
    return d.join(a, key, "full_outer").select(key, action.alias("action"))


def service_action(state: Column) -> Column:
    return F.when(state == "failed", F.lit("restart")).when(state == "inactive", F.lit("start"))


def after(df: DataFrame, failed: str, name: str = "name", order: str = "start_order") -> DataFrame:
    """The failed one and those started after it, with the order to stop them in (last first) and to start them in."""
    at = df.where(F.col(name) == failed).agg(F.min(order).alias("__from"))
    # one row each, made by aggregations; without the failed one no place is after it
    rest = df.crossJoin(F.broadcast(at)).where(F.col(order) >= F.col("__from")).drop("__from")
    placed = prefix_sum(rest, [], [order], F.lit(1), "__before")
    total = placed.agg(F.count("*").alias("__all"))
    return placed.crossJoin(F.broadcast(total)).withColumns({"stop_place": (F.col("__all") - F.col("__before")).cast("int"), "start_place": (F.col("__before") + 1).cast("int")}).drop("__before", "__all")


def alert(tool: str, action: Column, description: Column, **params: Column) -> Column:
    """The row that all detectors share: tool, action, parameters as text, description."""
    entries = [x for k, v in params.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(F.lit(tool).alias("tool"), action.alias("action"), F.create_map(*entries).alias("params"), description.alias("description"))
