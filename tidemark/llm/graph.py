"""Connected components of a link table, and the join of rows to groups of which some are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, release


def components(links: DataFrame, a: str, b: str, parts: int = 8) -> DataFrame:
    """node, comp (smallest node reachable) of every node of an undirected link table.

    Each round takes the smallest label among the neighbours and then follows that label's own label, so long chains
    shorten to about half; labels are checkpointed and nothing but the number of changes reaches the driver. parts says
    in how many partitions, for the size of the table, the rounds run.
    """
    x, y = links.select(F.col(a).alias("node"), F.col(b).alias("other")), links.select(F.col(b).alias("node"), F.col(a).alias("other"))
    edges = checkpoint(x.unionByName(y).filter("node <> other").distinct().coalesce(parts))
    labels = checkpoint(edges.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("comp")).coalesce(parts))
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("c")), "other").coalesce(parts)
        own = near.select("node", "c", F.lit(None).cast("bigint").alias("old")).unionByName(labels.select("node", F.col("comp").alias("c"), F.col("comp").alias("old")))
        step = own.groupBy("node").agg(F.min("c").alias("comp"), F.min("old").alias("old")).coalesce(parts)
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = step.join(jump, "comp").coalesce(parts).select("node", "old", F.least("comp", "further").alias("comp"))
        new = checkpoint(new)
        labels = new.select("node", "comp")
        if not new.filter("old <> comp").limit(1).count():
            return labels
        release(links.sparkSession)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, hot_rows: int = 1024) -> DataFrame:
    """Left join of rows to groups on `key`. Groups with at least a thousandth of all rows, a thousand at most, are
    broadcast, so no task gets all rows of a hot group."""
    least = max(hot_rows, total // 1000)
    hot = groups.filter(F.col(size) >= least).withColumn("__hot", F.lit(True))
    met = rows.join(F.broadcast(hot), key, "left")
    large = met.filter("__hot").drop("__hot")
    small = met.filter("__hot IS NULL").select(*rows.columns).join(groups.filter(F.col(size) < least), key, "left")
    return large.unionByName(small.select(*large.columns))
