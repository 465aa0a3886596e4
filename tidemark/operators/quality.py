"""Deduplication and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows of a hot key are reduced before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__v")).select("__v.*")


def inject_duplicates(df: DataFrame, number: str, every: int) -> DataFrame:
    """The rows, and every n-th of them (but number 0) once more."""
    return df.unionByName(df.filter((F.pmod(F.col(number), F.lit(every)) == 0) & (F.col(number) > 0)))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows in all, keys that repeat, rows beyond the first of each key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 1).alias("dup_keys"), F.sum(F.col("n") - 1).alias("surplus"))


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: both counts, their difference, and whether it is within a tenth of the source and 50."""
    a, b = source.agg(F.count(F.lit(1)).alias("source_rows")), target.agg(F.count(F.lit(1)).alias("target_rows"))
    both = a.join(b)  # one row each
    lag = F.abs(F.col("source_rows") - F.col("target_rows"))
    return both.withColumns({"lag": lag, "within": lag <= F.floor(F.col("source_rows") / 10) + 50})


def coverage(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: all rows, and the rows of each condition."""
    return df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def split_orders_fills(trades: DataFrame, key: str, drop_percent: int = 20, orphan_percent: int = 5) -> tuple[DataFrame, DataFrame]:
    """Orders, and their fills with some dropped and some of unknown orders, by hash buckets of the key."""
    bucket = F.pmod(F.xxhash64(key), F.lit(100))
    fills = trades.filter(bucket >= drop_percent)
    orphan = F.pmod(F.xxhash64(F.lit("orphan"), F.col(key)), F.lit(100)) < orphan_percent
    return trades, fills.withColumn(key, F.when(orphan, F.concat(F.lit("X-"), F.col(key).cast("string"))).otherwise(F.col(key).cast("string")))
