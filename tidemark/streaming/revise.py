"""Join of a stream of facts with a keyed table that changes: earlier results are revised by the table's change feed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.functions.expressions import key_bucket
from tidemark.sources.keyed import KeyedTable, join_keys, pushed_keys
from tidemark.streaming.run import run_batches


@dataclass
class RevisedJoin:
    """Inner join of facts with the present rows of a keyed table, as a log of changes in path/results/batch_id=N.

    A micro-batch holds new facts, change rows of the table, or both. New facts meet the table as it is after the batch
    (+I). Earlier facts of changed keys are read again, only from the buckets of those keys (and of few keys only the
    pages that hold them): their old results are taken
    back (-U) and given anew (+U), or given for the first time where the key is new (+I). What the join needs of the table
    is a keyed table of its own, so a batch sees the changes that have come to it, no more; that table is merged as the
    batch's last step, and a batch that runs again reads the snapshot before its own. So a replay gives the same rows.

    Defined cases: null keys match nothing; of several changes of a key in one batch the last one counts; a change that
    leaves the joined columns as they are revises nothing; facts that repeat are joined as often as they are there.
    """

    spark: SparkSession
    path: str
    facts: StructType
    table: StructType
    keys: list[str]
    buckets: int = 8
    held: KeyedTable = field(init=False)

    def __post_init__(self) -> None:
        schema = StructType([*self.table, StructField("__batch", LongType())])
        self.held = KeyedTable(self.spark, f"{self.path}/table", schema, self.keys, buckets=self.buckets, order="__batch")

    def input(self, facts: DataFrame, changes: DataFrame) -> DataFrame:
        """Both streams in one. changes: op, the table's columns and batch_id, as KeyedTable.change_stream() has them."""
        fact, row = F.struct(*self.facts.names), F.struct(*self.table.names)
        kinds = StructType([StructField("fact", self.facts), StructField("row", self.table), StructField("op", StringType()), StructField("version", LongType())])
        null = lambda c: F.lit(None).cast(kinds[c].dataType).alias(c)
        a = facts.select(fact.cast(self.facts).alias("fact"), null("row"), null("op"), null("version"))
        return a.unionByName(changes.select(null("fact"), row.cast(self.table).alias("row"), "op", F.col("batch_id").alias("version")))

    def _before(self, batch_id: int) -> DataFrame:
        """The table as it was before this batch."""
        number = max((m["snapshot_id"] for m in self.held.manifests() if m["batch_id"] < batch_id), default=None)
        return self.held.read(snapshot=number) if number else self.spark.createDataFrame([], self.held.schema)

    def each(self, batch: DataFrame, batch_id: int) -> None:
        names, bucket = self.table.names, key_bucket(F.struct(*self.keys) if len(self.keys) > 1 else F.col(self.keys[0]), self.buckets)
        kept = batch.persist()
        try:
            fresh = kept.filter("fact IS NOT NULL").select("fact.*")
            fresh.withColumn("__bucket", bucket).sortWithinPartitions("__bucket", *self.keys).write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/facts/batch_id={batch_id}")
            changed = kept.filter("op IN ('+I', '+U')").select("row.*", "version").groupBy(*self.keys)
            changed = changed.agg(F.max_by(F.struct(*names), "version").alias("__row")).select("__row.*").persist()
            touched = sorted(r[0] for r in changed.select(bucket.alias("b")).distinct().collect())
            before = self._before(batch_id)
            now = join_keys(before, changed, self.keys, "left_anti").select(*names).unionByName(changed.select(*names)) if touched else before.select(*names)
            out = fresh.join(now, self.keys).withColumn("op", F.lit("+I"))
            if touched and batch_id:
                schema = StructType([*self.facts, StructField("batch_id", LongType()), StructField("__bucket", LongType())])
                history = self.spark.read.schema(schema).parquet(f"{self.path}/facts").filter((F.col("batch_id") < batch_id) & F.col("__bucket").isin(touched)).select(*self.facts.names)
                old = before.select(*self.keys, F.struct(*names).alias("__old"))
                new = changed.select(*self.keys, F.struct(*names).alias("__new")).join(old, self.keys, "left").filter("__old IS NULL OR NOT (__old <=> __new)")
                revised = pushed_keys(history, changed, self.keys).join(new, self.keys).drop(*self.keys)
                again = F.when(F.col("__old").isNotNull(), F.array(F.struct(F.lit("-U").alias("op"), F.col("__old").alias("v")), F.struct(F.lit("+U").alias("op"), F.col("__new").alias("v"))))
                again = again.otherwise(F.array(F.struct(F.lit("+I").alias("op"), F.col("__new").alias("v"))))
                revised = revised.withColumn("__change", F.explode(again)).select("*", "__change.op", "__change.v.*")
                out = out.unionByName(revised.select(*out.columns))
            out.write.mode("overwrite").parquet(f"{self.path}/results/batch_id={batch_id}")
            if touched:
                self.held.merge(changed.select(*names, F.lit(batch_id).cast("bigint").alias("__batch")), batch_id)
            changed.unpersist()
        finally:
            kept.unpersist()

    def run(self, facts: DataFrame, changes: DataFrame) -> None:
        """Take in all that both streams have; goes on where it ended."""
        run_batches(self.input(facts, changes), self.each, "revised", checkpoint=f"{self.path}/state")

    def log(self) -> DataFrame:
        """op, the joined columns and batch_id of all results so far."""
        return self.spark.read.parquet(f"{self.path}/results")


def folded(log: DataFrame, upto: int) -> DataFrame:
    """The join's rows after a batch: those that the log has added more often than taken back, as often."""
    names = [c for c in log.columns if c not in ("op", "batch_id")]
    sign = F.when(F.col("op").startswith("+"), 1).otherwise(-1)
    net = log.filter(F.col("batch_id") <= upto).groupBy(*names).agg(F.sum(sign).alias("__n")).filter("__n > 0")
    return net.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*names)
