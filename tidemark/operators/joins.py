"""Joins of streams and tables: tagged full, interval, window, as-of, lookup, and revisions by a changing dimension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: A dimension is broadcast up to so many rows and bytes of checked numbers; beyond, the join shuffles and AQE splits hot keys.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000


def _on(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k] == right[k] for k in on))


def tagged_full_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join with join_kind INNER, LEFT_ORPHAN or RIGHT_ORPHAN; key columns hold the side that is there."""
    l, r = left.withColumn("__l", F.lit(1)), right.withColumn("__r", F.lit(1))  # noqa: E741
    kind = F.when(F.col("__l").isNull(), "RIGHT_ORPHAN").when(F.col("__r").isNull(), "LEFT_ORPHAN").otherwise("INNER")
    return l.join(r, on, "full_outer").withColumn("join_kind", kind).drop("__l", "__r")


def interval_join(left: DataFrame, right: DataFrame, on: list[str], lts: str, rts: str, lower: str, upper: str, how: str = "inner") -> DataFrame:
    """Pairs of equal keys with right time between left time + lower and left time + upper, both ends in.

    lower and upper are interval texts such as '-5 seconds'. Works on batch and on watermarked streaming inputs, whose
    state is bounded by the condition.
    """
    between = right[rts].between(left[lts] + F.expr(f"interval {lower}"), left[lts] + F.expr(f"interval {upper}"))
    joined = left.join(right, _on(left, right, on) & between, how)
    return reduce(lambda df, k: df.drop(right[k]), on, joined)


def bucketed_interval_join(left: DataFrame, right: DataFrame, on: list[str], lts: str, rts: str, before_s: int, after_s: int) -> DataFrame:
    """Batch interval join whose hot keys are split by time: equality on key and time bucket, then the exact bounds.

    Buckets are as wide as the interval, so a left row meets the two or three buckets its interval touches and no key
    has all its rows in one task.
    """
    width = max(1, before_s + after_s)
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    low, high = seconds(left[lts]) - before_s * 1_000_000, seconds(left[lts]) + after_s * 1_000_000
    w = width * 1_000_000
    l = left.withColumns({"__low": low, "__high": high}).withColumn("__b", F.explode(F.expr(f"sequence(floor(__low / {w}), floor(__high / {w}))")))  # noqa: E741
    r = right.withColumn("__t", seconds(right[rts])).withColumn("__b", F.floor(F.col("__t") / w))
    return l.join(r, [*on, "__b"]).filter("__t BETWEEN __low AND __high").drop("__b", "__low", "__high", "__t")


def window_join(left: DataFrame, right: DataFrame, on: list[str], lts: str, rts: str, size: str, names: tuple[str, str] = ("left_count", "right_count")) -> DataFrame:
    """Rows of each side for every key and tumbling window in which both sides have some: one union, one aggregation."""
    sides = left.select(*on, F.col(lts).alias("__ts"), F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(right.select(*on, F.col(rts).alias("__ts"), F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    counts = sides.groupBy(*on, F.window("__ts", size).alias("w")).agg(F.sum("__l").alias(names[0]), F.sum("__r").alias(names[1]))
    return counts.filter((F.col(names[0]) > 0) & (F.col(names[1]) > 0)).select(*on, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *names)


def asof_join(left: DataFrame, right: DataFrame, on: list[str], lts: str, rts: str, cols: list[str], max_age: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Left rows with `cols` of the right row of the same key with the latest rts <= lts; null where there is none, where
    it is older than max_age, or where the key or lts is null. Right rows without a time match nothing.

    One shuffle and one sort of the union of both sides. Right rows that tie on key and time: the largest values win.
    For few or hot keys, `bucket` (an ascending function of the time, which it names __ts) splits a key into one task a
    bucket: what was last before a bucket is carried over from one row for each key and bucket.
    """
    right = right.filter(F.col(rts).isNotNull())
    found = F.struct(F.col(rts).alias("__rts"), *cols)
    l = left.select(*on, F.col(lts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(found.alias("x")).schema["x"].dataType).alias("__found"))  # noqa: E741
    r = right.select(*on, F.col(rts).alias("__ts"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), found.alias("__found"))
    rows, keys = l.unionByName(r), [*on]
    if bucket is not None:
        rows, keys = rows.withColumn("__bucket", bucket), [*on, "__bucket"]
    w = Window.partitionBy(*keys).orderBy("__ts", "__side", "__found").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__last", F.last("__found", ignorenulls=True).over(w)).filter("__side = 1")
    if bucket is not None:
        ends = rows.groupBy(*keys).agg(F.max("__found").alias("__end"))  # __found begins with its time
        earlier = Window.partitionBy(*on).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*keys, F.last("__end", ignorenulls=True).over(earlier).alias("__carried")).filter("__carried IS NOT NULL")
        out = out.join(carried, keys, "left").withColumn("__last", F.coalesce("__last", "__carried"))
    fresh = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in [*on, "__ts"]))
    if max_age is not None:
        fresh &= F.col("__ts") - F.expr(f"interval {max_age}") <= F.col("__last.__rts")
    return out.select("__row.*", *(F.when(fresh, F.col("__last")[c]).alias(c) for c in cols))


def small(df: DataFrame) -> bool:
    """May the rows be broadcast? Counts them and the bytes of their values (texts as they are, other values as text)."""
    size = lambda c: F.coalesce(F.octet_length(F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType)) else F.col(c).cast("string")), F.lit(0))
    if len(df.limit(BROADCAST_ROWS + 1).select(F.lit(1)).groupBy().count().filter(F.col("count") > BROADCAST_ROWS).head(1)):
        return False  # a larger table isn't read to its end
    rows, width = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(reduce(lambda a, b: a + b, map(size, df.columns))), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and width <= BROADCAST_BYTES


def lookup_join(facts: DataFrame, dim: DataFrame, on: list[str], cols: list[str], how: str = "left") -> DataFrame:
    """Facts with columns of the current dimension row. Of the dimension only keys and `cols` are read; it is broadcast
    if its checked rows and bytes are few, and shuffled with the facts' keys otherwise."""
    narrow = dim.select(*on, *cols)
    if not facts.isStreaming and small(narrow):
        narrow = F.broadcast(narrow)
    return facts.join(narrow, on, how)


def revise_join(delta_facts: DataFrame, facts: DataFrame, delta_dim: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """What a batch adds to facts joined with a changing dimension: new facts on the dimension as it is after the batch
    (op +I), and earlier facts of changed keys again with their new values (op +U). No row is given twice.

    facts is the history before the batch, dim the table before it; the history is read by changed keys alone.
    """
    changed = delta_dim.select(*on).distinct()
    now = dim.join(changed, on, "left_anti").unionByName(delta_dim)
    added = delta_facts.join(now, on).withColumn("op", F.lit("+I"))
    revised = facts.join(changed, on, "left_semi").join(delta_dim, on).withColumn("op", F.lit("+U"))
    return added.unionByName(revised)
