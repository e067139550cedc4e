"""A run of steps that tells how far it is and can be cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Cancelled(Exception):
    """The run was cancelled; what its current step was writing isn't there."""


@dataclass
class Step:
    """name, work in units, and what makes its rows and writes them (all or nothing)."""

    name: str
    units: float
    rows: Callable[[], DataFrame]
    write: Callable[[DataFrame], None]


@dataclass
class Run:
    """Steps one after the other. progress(step, percent, rows) is called when a step has ended; the percentage never falls, and is 99
    at most until all is done. `cancel` may be called from any thread: jobs that run are interrupted by the run's tag, and no
    further step starts. Rows are counted by an observation on the way to the sink, not by a job of their own."""

    spark: SparkSession
    steps: list[Step]
    progress: Callable[[str, int, int], None] = lambda *_: None
    tag: str = field(default_factory=lambda: f"run-{uuid.uuid4().hex}")

    def __post_init__(self) -> None:
        self._stop, self.percent, self.done = threading.Event(), 0, []

    def cancel(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _tell(self, name: str, units: float, rows: int) -> None:
        total = sum(s.units for s in self.steps)
        now = 100 if len(self.done) == len(self.steps) else min(99, int(units / total * 100)) if total > 0 else 0
        self.percent = max(self.percent, now)
        self.progress(name, self.percent, rows)

    def start(self) -> dict[str, int]:
        """Rows of each step. Raises Cancelled if it was cancelled, and what a step raises if it fails."""
        sc, rows, units = self.spark.sparkContext, {}, 0.0
        sc.addJobTag(self.tag)
        try:
            for s in self.steps:
                if self._stop.is_set():
                    raise Cancelled(s.name)
                seen = Observation()
                try:
                    s.write(s.rows().observe(seen, F.count(F.lit(1)).alias("rows")))
                except Exception as e:
                    if self._stop.is_set():
                        raise Cancelled(s.name) from e
                    raise
                units += s.units
                self.done.append(s.name)
                rows[s.name] = seen.get.get("rows", 0)
                self._tell(s.name, units, rows[s.name])
        finally:
            sc.removeJobTag(self.tag)
        return rows
