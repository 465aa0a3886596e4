"""Hot and cold tiers of a log: a copy with bucket, offset and commit time, and reads over both without double counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.windows import running_count
from tidemark.sources.keyed import merge_last
from tidemark.streaming.run import run_batches


def tiered(hot: DataFrame, bucket: Column, order: list[str], start: DataFrame | None = None, commit_time: Column | None = None) -> DataFrame:
    """Hot rows with __bucket and __offset: their number in the bucket, after the offsets that `start` (__bucket,
    __next) says are taken; with commit_time also __timestamp. Offsets are counted over ranges of bucket and order, so a
    bucket lies in many tasks."""
    rows = hot.withColumn("__bucket", bucket)
    if commit_time is not None:
        rows = rows.withColumn("__timestamp", commit_time)
    numbered = running_count(rows, "__bucket", order, "__offset").withColumn("__offset", F.col("__offset") - 1)
    if start is None:
        return numbered
    return numbered.join(F.broadcast(start), "__bucket", "left").withColumn("__offset", F.col("__offset") + F.coalesce("__next", F.lit(0))).drop("__next")


def copy_fresh(hot: DataFrame, cold_path: str, bucket: Column, order: list[str], offset_of: str, now: Column) -> int:
    """One run of the tiering job: hot rows whose position (`offset_of`, ascending in arrival) lies beyond what the cold
    table holds are appended to it with bucket, offset and commit time. Returns how many. For a log without a stream: it reads
    the cold tier's offsets, and takes neither rows that come late nor a run that broke off; tiering() does."""
    spark = hot.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cold_path)
    start = None
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        cold = spark.read.parquet(cold_path)
        hot = hot.filter(F.col(offset_of) > cold.agg(F.max(offset_of)).first()[0])
        start = watermarks(cold)
    rows = tiered(hot, bucket, order, start, now).persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(cold_path)
        return n
    finally:
        rows.unpersist()


def copy_batch(batch: DataFrame, batch_id: int, cold_path: str, bucket: Column, order: list[str], now: Column) -> None:
    """One micro-batch of the tiering stream: its rows with bucket, offset and commit time in cold_path/rows/batch_id=N, and
    then each bucket's next offset in cold_path/next/batch_id=N.

    Offsets go on from what the batch before has left, so neither tier is read, whatever its size; a row that comes late is
    copied like any other. A batch that runs again after a lost driver finds the same start, and replaces its rows.
    """
    spark = batch.sparkSession
    start = spark.createDataFrame([], "__bucket int, __next bigint") if not batch_id else spark.read.parquet(f"{cold_path}/next/batch_id={batch_id - 1}")
    rows = tiered(batch, bucket.cast("int"), order, start, now).persist()
    try:
        rows.write.mode("overwrite").parquet(f"{cold_path}/rows/batch_id={batch_id}")
        last = rows.groupBy("__bucket").agg((F.max("__offset") + 1).alias("__next"))
        last.unionByName(start).groupBy("__bucket").agg(F.max("__next").alias("__next")).coalesce(1).write.mode("overwrite").parquet(f"{cold_path}/next/batch_id={batch_id}")
    finally:
        rows.unpersist()


def tiering(hot: DataFrame, cold_path: str, bucket: Column, order: list[str], now: Column | None = None) -> None:
    """Copy what a stream of the hot log has had since the last run; run it as often as the cold tier's freshness asks for."""
    at = F.current_timestamp() if now is None else now
    run_batches(hot, lambda batch, i: copy_batch(batch, i, cold_path, bucket, order, at), "tiering", checkpoint=f"{cold_path}/state")


def cold_tier(spark: SparkSession, cold_path: str) -> DataFrame:
    """What has been copied."""
    return spark.read.parquet(f"{cold_path}/rows").drop("batch_id")


def watermarks(cold: DataFrame) -> DataFrame:
    """__bucket and __next: the first offset that isn't in the cold tier; a row for each bucket."""
    return cold.groupBy("__bucket").agg((F.max("__offset") + 1).alias("__next"))


def unified_log(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """The whole log: cold rows, and hot rows beyond what was copied of their bucket."""
    fresh = hot.join(F.broadcast(watermarks(cold)), "__bucket", "left").filter("__offset >= coalesce(__next, 0)").drop("__next")
    return cold.select(*hot.columns).unionByName(fresh.select(*hot.columns))


def unified_keyed(hot: DataFrame, cold: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key over both tiers; null orders come first, and ties are decided by the other columns."""
    return merge_last(hot.unionByName(cold.select(*hot.columns)), keys, order)


def bucket_report(log: DataFrame) -> DataFrame:
    """Rows and the span of offsets, and of commit times where the log has them, of each bucket."""
    spans = [f("__offset").alias(f"{n}_offset") for n, f in (("min", F.min), ("max", F.max))]
    if "__timestamp" in log.columns:
        spans += [f("__timestamp").alias(f"{n}_timestamp") for n, f in (("min", F.min), ("max", F.max))]
    return log.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"), *spans)
