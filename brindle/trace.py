"""What the stages of a composed query cost: how long each took, how many rows it gave, and whether it ended well."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from brindle.session import written


@dataclass
class Trace:
    """Stages in the order they ended; a stage is written, so that its time is its own and the next reads what is there."""

    stages: list[tuple[str, float, int, bool]] = field(default_factory=list)

    def stage(self, name: str, work: Callable[[], DataFrame]) -> DataFrame:
        """work()'s rows, written; a stage that fails is kept as such, and its error goes on."""
        began, rows, fine = time.perf_counter(), 0, False
        try:
            out = written(work(), name)
            rows, fine = out.count(), True
            return out
        finally:
            self.stages.append((name, (time.perf_counter() - began) * 1000, rows, fine))

    def table(self, spark: SparkSession) -> DataFrame:
        """place, stage, elapsed_ms, items, success."""
        return spark.createDataFrame([(k, *s) for k, s in enumerate(self.stages)], "place int, stage string, elapsed_ms double, items long, success boolean")
