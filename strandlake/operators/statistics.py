"""Figures of a run, gathered while the data pass by."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class RunStatistics:
    """Counts and times of the steps of a job.

    ``watch`` adds counters to a DataFrame that is used anyway, so counting costs no job of its own; ``table`` has one row for each figure
    once the watched data have been written.
    """

    began: float = field(default_factory=time.time)
    watched: list[tuple[str, Observation]] = field(default_factory=list)
    noted: list[tuple[str, str, float]] = field(default_factory=list)

    def watch(self, rows: DataFrame, step: str, **sums: str) -> DataFrame:
        """``rows``, whose number and sums of expressions are noted under ``step``."""
        seen = Observation(f"{step}-{uuid.uuid4().hex}")
        self.watched.append((step, seen))
        return rows.observe(seen, F.count(F.lit(1)).cast("double").alias("rows"), *(F.sum(F.expr(e)).cast("double").alias(k) for k, e in sums.items()))

    def note(self, step: str, **figures: float) -> None:
        self.noted += [(step, k, float(v)) for k, v in figures.items()]

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, figure, value), among them the seconds since the start."""
        seen = [(step, k, v) for step, o in self.watched for k, v in o.get.items()]
        return spark.createDataFrame([*seen, *self.noted, ("run", "seconds", time.time() - self.began)], "step string, figure string, value double")

    def lines(self, spark: SparkSession) -> list[str]:
        """The table as lines of a log."""
        return [f"{r.step:<24}{r.figure:<16}{r.value if r.value is not None else 0:>16,.6g}" for r in self.table(spark).collect()]
