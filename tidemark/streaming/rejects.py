"""Messages that can't be read, counted by reason while the rest goes on: observed metrics of batches and of streams."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StringType, StructType

from tidemark.sources.io import camel

REASONS = ("empty", "malformed", "no_key")


def _both(schema: StructType) -> StructType:
    """The schema's fields under both spellings."""
    out = StructType(list(schema))
    for f in schema:
        if camel(f.name) != f.name:
            out = out.add(camel(f.name), f.dataType)
    return out


def with_reason(raw: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns from the JSON text in `value`, and `reject`: empty (no text), malformed (no JSON object, or a
    field of another type), no_key (the first column is null), or null for rows that are good."""
    parsed = raw.select("value", F.from_json("value", _both(schema).add("__corrupt", StringType()), {"columnNameOfCorruptRecord": "__corrupt"}).alias("v"))
    cols = [F.coalesce(*(F.col("v")[n] for n in dict.fromkeys((f.name, camel(f.name))))).alias(f.name) for f in schema]
    first = schema[0].name
    out = parsed.select(*cols, F.trim("value").alias("__text"), F.col("v.__corrupt").alias("__bad"))
    reason = F.when(F.coalesce(F.col("__text"), F.lit("")) == "", "empty").when(F.col("__bad").isNotNull(), "malformed").when(F.col(first).isNull(), "no_key")
    return out.withColumn("reject", reason).drop("__text", "__bad")


def _counts() -> list[Column]:
    return [F.count(F.when(F.col("reject") == r, 1)).alias(r) for r in REASONS] + [F.count(F.when(F.col("reject").isNull(), 1)).alias("good")]


def parse_counted(raw: DataFrame, schema: StructType, name: str) -> tuple[DataFrame, Observation | None]:
    """Good rows alone; rejects are counted on the way, without another pass. A batch's counts are in the observation once
    an action has run; a stream's come to a RejectCounts listener under `name`. Write the good rows as they come: what evaluates the plan twice in one action,
    as a sort does to find its ranges, counts twice."""
    rows = with_reason(raw, schema)
    seen = None if raw.isStreaming else Observation(name)
    observed = rows.observe(name if seen is None else seen, *_counts())
    return observed.filter("reject IS NULL").drop("reject"), seen


class RejectCounts(StreamingQueryListener):
    """Adds up the counts of a name over the micro-batches of its streams. A batch that runs again counts once."""

    def __init__(self, name: str):
        self.name, self.batches, self.ended = name, {}, threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None and event.progress.numInputRows:
            self.batches[str(event.progress.id), event.progress.batchId] = found.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def totals(self, wait_s: float = 30) -> Counter:
        """Counts so far; events come a little later than the batches, so the end of the stream is waited for."""
        if not self.ended.wait(wait_s):
            raise TimeoutError(f"{self.name}: no end of the stream was told within {wait_s} s")
        return sum((Counter(b) for b in self.batches.values()), Counter())
