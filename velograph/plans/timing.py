"""Durations of a run's phases."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PHASES = ("initialisation", "{mode}", "fluid_moments", "gpu2cpu", "write")


class Stopwatch:
    """Time points in order; the last row is the time from the first to the last."""

    def __init__(self):
        self.points = [time.perf_counter()]
        self.names: list[str] = []

    def lap(self, name: str) -> None:
        self.points.append(time.perf_counter())
        self.names.append(name)

    def table(self) -> tuple[list[str], list[float]]:
        laps = [b - a for a, b in zip(self.points, self.points[1:], strict=False)]
        return [*self.names, "total"], [*laps, self.points[-1] - self.points[0]]


def durations(points: DataFrame, order: str = "ord", at: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
    """points with `seconds` until the next one of the same group; the last point of a group drops out."""
    w = Window.partitionBy(*by).orderBy(order)
    return points.withColumn("seconds", F.lead(at).over(w) - F.col(at)).where(F.col("seconds").isNotNull())
