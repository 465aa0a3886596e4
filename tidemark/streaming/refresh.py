"""Stream lookups in a dimension that changes: read again after an interval, one version kept between two reads."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import small
from tidemark.streaming.run import run_batches
from tidemark.workdir import delete, scratch


class RefreshedDimension:
    """A dimension that `load` resolves anew (a new DataFrame, hence a new list of files) once the version at hand is
    `every_s` seconds old; with 0, at each use. A version is written to the shared folder, so that executors which are
    lost don't bring rows of a later one, and deleted when the next one replaces it.

    What a row is joined with is at most `every_s` older than the use. A load that fails leaves the version at hand.
    """

    def __init__(self, spark: SparkSession, load: Callable[[], DataFrame], every_s: float = 0, clock: Callable[[], float] = time.time):
        self.spark, self.load, self.every_s, self.clock = spark, load, every_s, clock
        self.path: str | None = None
        self.read_at = 0.0
        self.loads = 0

    def current(self) -> DataFrame:
        now = self.clock()
        if self.path is None or now - self.read_at >= self.every_s:
            path = scratch(self.spark, "dimension")
            self.load().write.parquet(path)
            self.release()
            self.path, self.read_at, self.loads = path, now, self.loads + 1
            self.few = small(self.spark.read.parquet(path))
        rows = self.spark.read.parquet(self.path)
        return F.broadcast(rows) if self.few else rows

    def release(self) -> None:
        if self.path:
            delete(self.spark, self.path)
            self.path = None


def refreshed_lookup(stream: DataFrame, dimension: RefreshedDimension, on: list[str], cols: list[str], out: str, name: str, how: str = "left", checkpoint: str | None = None) -> None:
    """Rows of the stream with columns of the dimension as it is when their micro-batch runs, in out/batch_id=N. A batch
    that runs again replaces what it wrote. Keys that the dimension holds more than once give a row each."""

    def each(batch: DataFrame, batch_id: int) -> None:
        found = batch.join(dimension.current().select(*on, *cols), on, how)
        found.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_batches(stream, each, name, checkpoint=checkpoint)
