"""The detectors as streams: event time and watermarks, state in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.logindex import LogIndex


def debounce(events: DataFrame, ts: str = "ts", path: str = "path", kind: str = "kind", quiet: str = "1500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """A row for each path once no event came for `quiet`; paths whose last event is a deletion are left out. Batch frames give the same."""
    by = events.withWatermark(ts, late).groupBy(path, F.session_window(ts, quiet).alias("s"))
    last = by.agg(F.max_by(kind, ts).alias("last"), F.count("*").alias("events"))
    return last.where("last <> 'deleted'").select(path, F.col("s.end").alias("ready_at"), "events")


def unseen(events: DataFrame, *ids: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each id once, while its first row is within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(ids))


def counts(events: DataFrame, by: str, ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each key and window, as the windows close."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", "w.end", by, "n")


def spikes(rates: DataFrame, by: str, value: str, order: str, threshold: float = 3.0, alpha: float = 0.1) -> DataFrame:
    """Rows whose value exceeds threshold times the key's baseline before them. State: the baseline (0 is unset). Within a batch rows go by `order`."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base = state.get[0] if state.exists else 0.0
        out = []
        for o, v in pd.concat(list(parts)).sort_values(order)[[order, value]].itertuples(index=False):
            if base > 0 and v > base * threshold:
                out.append((key[0], o, float(v), base))
            base = float(v) if base == 0 else alpha * v + (1 - alpha) * base
        state.update((base,))
        yield pd.DataFrame(out, columns=[by, order, value, "before"])

    kinds = dict(rates.dtypes)
    schema = f"{by} {kinds[by]}, {order} {kinds[order]}, {value} double, before double"
    return rates.groupBy(by).applyInPandasWithState(step, schema, "base double", "append", GroupStateTimeout.NoTimeout)


def restart_limiter(attempts: DataFrame, by: str, ts_us: str, id_: str, most: int = 5, seconds: float = 60) -> DataFrame:
    """Each attempt with whether it is allowed. State: the times of the allowed ones within the period, `most` at most."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for at, i in pd.concat(list(parts)).sort_values([ts_us, id_])[[ts_us, id_]].itertuples(index=False):
            held = [t for t in held if at - t <= seconds * 1_000_000]
            ok = len(held) < most
            held += [at] * ok
            out.append((key[0], i, ok))
        state.update((held,))
        yield pd.DataFrame(out, columns=[by, id_, "allowed"])

    kinds = dict(attempts.dtypes)
    return attempts.groupBy(by).applyInPandasWithState(step, f"{by} {kinds[by]}, {id_} {kinds[id_]}, allowed boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def keep_index(new_rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, version: str | None = None, deleted: str | None = None, most: int = 8):
    """A query that replaces, batch by batch, the rows of the paths that came, in the log-structured index at `path`.

    With `version`, a column that tells versions of a path apart, only the rows of the greatest one in a batch count. With `deleted`,
    a boolean column, paths whose counting rows are all marked go from the index. Each batch writes only its buckets; those of more
    than `most` segments are compacted now and then. A batch that is run again after a failure is recognised and left out."""

    def write(batch: DataFrame, number: int) -> None:
        index, own = LogIndex(batch.sparkSession, path), batch.drop(*([deleted] if deleted else []))
        if version:
            last = batch.groupBy("path").agg(F.max(version).alias("__last"))
            batch = batch.join(last, "path").where(F.col(version).eqNullSafe(F.col("__last")))
        live = batch.where(~F.col(deleted)) if deleted else batch
        index.upsert(live.select(*own.columns), batch.select("path"), batch=(checkpoint, number))
        if number % most == most - 1:
            index.compact(most)

    return new_rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
