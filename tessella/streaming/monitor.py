"""A monitor: one cycle for each micro-batch. Detectors see the batch and give rows of the common alert shape; one that fails is counted and doesn't stop the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Detector = Callable[[DataFrame], DataFrame]


@dataclass
class Monitor:
    detectors: dict[str, Detector]
    sink: Callable[[DataFrame, str], None]
    cycles: int = 0
    errors: dict[str, int] = field(default_factory=dict)

    def cycle(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, detect in self.detectors.items():
                try:
                    self.sink(detect(batch).withColumns({"detector": F.lit(name), "cycle": F.lit(batch_id)}), name)
                except Exception:
                    self.errors[name] = self.errors.get(name, 0) + 1
            self.cycles += 1
        finally:
            batch.unpersist()

    @property
    def error_rate(self) -> float:
        return sum(self.errors.values()) / max(1, self.cycles)

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None):
        """A cycle `every` interval, or one pass over what is there."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return stream.writeStream.foreachBatch(self.cycle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
