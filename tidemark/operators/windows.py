"""Tumbling windows, running counts, and late rows measured against a watermark of one's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.workdir import checkpoint


def tumbling(df: DataFrame, keys: list[str], ts: str, size: str, aggs: list[Column], delay: str | None = None) -> DataFrame:
    """Aggregates for each key and tumbling window. With delay the input is watermarked: a stream then closes a window
    once the largest time seen, less the delay, has passed its end."""
    if delay is not None:
        df = df.withWatermark(ts, delay)
    out = df.groupBy(*keys, F.window(ts, size).alias("__w")).agg(*aggs)
    return out.select(*keys, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *[c for c in out.columns if c not in (*keys, "__w")])


def count_report(df: DataFrame, key: str, size: str, ts: str | None = None) -> DataFrame:
    """Counts for each key and window as trade-shaped report rows. Without ts, processing time: one value a micro-batch."""
    timed = df.withColumn("__ts", F.current_timestamp() if ts is None else F.col(ts))
    counts = tumbling(timed, [key], "__ts", size, [F.count(F.lit(1)).alias("quantity")])
    return counts.select(F.expr("uuid()").alias("event_id"), key, F.lit("COUNT").alias("ticker"), F.lit("REPORT").alias("side"), "quantity", F.lit(0.0).alias("price"), F.unix_millis("window_end").alias("trade_time"))


def running_count(df: DataFrame, key: str, order: list[str], name: str = "n") -> DataFrame:
    """Number of the key's rows so far, on each row.

    Rows are range-partitioned by key and order, so a hot key lies in many tasks; only keys that go on from one range
    to the next, at most one a range, need an offset.
    """
    dealt = checkpoint(df.repartitionByRange(key, *order).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy(key, "__p").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.withColumn("__before", F.sum("__c").over(Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).filter("__before > 0")
    numbered = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__p", key).orderBy(*order)))
    joined = numbered.join(F.broadcast(before.select(F.col(key).alias("__k"), F.col("__p").alias("__q"), "__before")), (F.col("__p") == F.col("__q")) & F.col(key).eqNullSafe(F.col("__k")), "left")
    return joined.select(*df.columns, (F.col("__n") + F.coalesce("__before", F.lit(0))).cast("bigint").alias(name))


def late_rows(df: DataFrame, ts: str, arrival: str, delay_ms: int) -> DataFrame:
    """Rows whose time lies before the watermark at their arrival: the largest time that arrived before, less the delay.
    Adds watermark_at_arrival_ms and lateness_ms (positive when late).

    The running maximum needs no single-partition window: rows are range-partitioned by arrival, each partition gives
    its maximum, the prefix of those few maxima is taken, and windows run inside partitions.
    """
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    dealt = checkpoint(df.withColumn("__ms", ms).repartitionByRange(arrival).withColumn("__p", F.spark_partition_id()))
    tops = dealt.groupBy("__p").agg(F.max("__ms").alias("__top"))  # one row for each partition
    before = tops.select("__p", F.max("__top").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = Window.partitionBy("__p").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.join(F.broadcast(before), "__p").withColumn("__seen", F.greatest(F.max("__ms").over(inside), F.col("__before")))
    mark = F.col("__seen") - delay_ms
    return seen.filter(F.col("__ms") < mark).withColumns({"watermark_at_arrival_ms": mark, "lateness_ms": mark - F.col("__ms")}).drop("__p", "__ms", "__before", "__seen")
