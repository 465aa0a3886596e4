"""Bounded runs of streaming plans: all that is there, then stop; results are written and read back."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemark.workdir import scratch


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """File stream of one table: a single parquet file, or a folder of them."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(batch.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.getFileStatus(fs_path).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: With RocksDB a commit writes the changes of a micro-batch, not a snapshot, and a join keeps one store a partition, not four.
ROCKS_SETTINGS = {"spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.join.stateFormatVersion": "3"}


@contextmanager
def settings(spark: SparkSession, policy: str | None = None) -> Iterator[None]:
    """Session settings that a query takes over when it starts, put back afterwards: the state store that processors with
    several states and timers need, unless the session names one of its own, with small commits; and whether the slowest
    (min) or the fastest (max) of several sources moves the watermark. A restarted query keeps what its checkpoint says."""
    wanted = {"spark.sql.streaming.multipleWatermarkPolicy": policy} if policy else {}
    if spark.conf.get(PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(PROVIDER, ""):
        wanted |= {PROVIDER: ROCKS} | ROCKS_SETTINGS
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def admitted(batches: DataFrame, source: str, ts: str) -> DataFrame:
    """batch_id, a column for each source with its largest time (epoch milliseconds) so far, and drift_ms: how far the sources
    are apart, from rows with batch_id, source and time. A source that has admitted nothing is null and has no drift."""
    tops = batches.groupBy("batch_id", source).agg(F.max(F.unix_millis(ts)).alias("top"))
    names = sorted(r[0] for r in tops.select(source).distinct().collect())
    wide = tops.groupBy("batch_id").pivot(source, names).agg(F.first("top"))
    so_far = Window.orderBy("batch_id")  # one row for each micro-batch
    wide = wide.select("batch_id", *(F.max(n).over(so_far).alias(n) for n in names))
    return wide.withColumn("drift_ms", (F.greatest(*names) - F.least(*names)) if len(names) > 1 else F.lit(0))


def start(writer: DataStreamWriter, spark: SparkSession, policy: str | None = None) -> StreamingQuery:
    with settings(spark, policy):
        return writer.start()


def run_to_parquet(plan: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, out: str | None = None, policy: str | None = None) -> DataFrame:
    """Run a stream over all available input into parquet (exactly once, by its metadata log) and read the result."""
    spark = plan.sparkSession
    out, checkpoint = out or scratch(spark, f"{name}-out"), checkpoint or scratch(spark, f"{name}-state")
    writer = plan.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    start(writer, spark, policy).awaitTermination()
    return spark.read.schema(plan.schema).parquet(out)


def run_batches(plan: DataFrame, each: Callable[[DataFrame, int], None], name: str, mode: str = "append", checkpoint: str | None = None, policy: str | None = None) -> None:
    """Run a stream over all available input through a function of (batch, batch id)."""
    checkpoint = checkpoint or scratch(plan.sparkSession, f"{name}-state")
    writer = plan.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    start(writer, plan.sparkSession, policy).awaitTermination()


def run_for(plan: DataFrame, name: str, rows: int, out: str, checkpoint: str, until: Callable[[DataFrame], bool] | None = None, most_s: float = 300) -> list:
    """Run a stream that goes by the clock, and so doesn't end by itself, into parquet until it has taken in so many rows
    and its results satisfy `until`; gives the progress of its last batches."""
    spark, met, seen, began = plan.sparkSession, 0, -1, time.monotonic()
    writer = plan.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds")
    query = start(writer, spark)
    try:
        while met < rows or (until is not None and not until(spark.read.schema(plan.schema).parquet(out))):
            if query.exception() or time.monotonic() - began > most_s:
                raise RuntimeError(f"{name}: {query.exception() or f'not done after {most_s} s'}")
            time.sleep(0.2)
            for p in query.recentProgress:
                if p["batchId"] > seen:
                    met, seen = met + p["numInputRows"], p["batchId"]
    finally:
        query.stop()
    return query.recentProgress


def feed(rows: DataFrame, part: str, parts: int, name: str, run_once: Callable[[DataFrame], None]) -> None:
    """Let rows arrive in `parts` parts (numbered by the column `part`): each is written, and run_once gets the stream of
    what has arrived. A run_once with a checkpoint of its own goes on where it ended, so every part is a restart."""
    folder, data = scratch(rows.sparkSession, name), rows.drop(part)
    for k in range(parts):
        rows.filter(F.col(part) == k).drop(part).write.parquet(f"{folder}/{k:04d}")
        run_once(rows.sparkSession.readStream.schema(data.schema).parquet(f"{folder}/*"))


def split_late(plan: DataFrame, ts: str, delay_ms: int, folder: str, name: str, checkpoint: str | None = None) -> None:
    """Side channel for late rows of a stream without a watermark: each batch is measured against the largest time of the
    batches before, less the delay; late rows go to folder/late with watermark_at_arrival_ms and lateness_ms, the others
    to folder/on_time. The maximum of each batch is a committed row of its own, so a replayed batch is split the same way."""
    spark = plan.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = batch.withColumn("__ms", F.unix_millis(F.col(ts).cast("timestamp"))).persist()
        try:
            seen = None
            if batch_id:
                seen = spark.read.schema("top bigint, batch_id bigint").parquet(f"{folder}/max").filter(F.col("batch_id") < batch_id).agg(F.max("top")).first()[0]
            mark = F.lit(None if seen is None else seen - delay_ms).cast("bigint")
            late = F.coalesce(F.col("__ms") < mark, F.lit(False))
            out = kept.filter(late).withColumns({"watermark_at_arrival_ms": mark, "lateness_ms": mark - F.col("__ms")}).drop("__ms")
            out.write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")
            kept.filter(~late).drop("__ms").write.mode("overwrite").parquet(f"{folder}/on_time/batch_id={batch_id}")
            kept.agg(F.max("__ms").alias("top")).write.mode("overwrite").parquet(f"{folder}/max/batch_id={batch_id}")
        finally:
            kept.unpersist()

    run_batches(plan, each, name, checkpoint=checkpoint)
