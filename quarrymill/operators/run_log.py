"""The log of a run: rows in and out, seconds, notes and warnings of its stages, counted in the one pass that stores each of them."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarrymill.storage import stored


class RunLog:
    """stage() stores a table and observes it on the way: no stage is read again for its counts. The metrics of a stage come from the tasks that write it, each
    of which counts once, however often it was tried."""

    def __init__(self):
        self.stages: list[dict] = []
        self.warnings: list[str] = []

    def stage(self, name: str, df: DataFrame, note: str = "", warnings: Mapping[str, Column] | None = None, rows_in: int | None = None) -> DataFrame:
        """``df``, stored. ``rows_in``: by default the rows of the stage before. Each warning is noted once in a run if its condition holds for a row."""
        seen, began = Observation(), time.monotonic()
        conditions = list((warnings or {}).items())
        own = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"w{k}") for k, (_, c) in enumerate(conditions)])
        out = stored(own, f"stage-{len(self.stages)}")
        got = seen.get
        before = self.stages[-1]["rows"] if self.stages else got["rows"]
        self.stages.append({"place": len(self.stages), "stage": name, "rows_in": before if rows_in is None else rows_in, "rows": got["rows"], "seconds": time.monotonic() - began, "note": note})
        for k, (message, _) in enumerate(conditions):
            if got[f"w{k}"]:
                self.warn(message)
        return out

    def warn(self, message: str) -> None:
        if message not in self.warnings:
            self.warnings.append(message)

    def table(self, spark: SparkSession) -> DataFrame:
        """place, stage, rows_in, rows, seconds, note."""
        names = "place int, stage string, rows_in long, rows long, seconds double, note string"
        return spark.createDataFrame([tuple(s.values()) for s in self.stages], names)
