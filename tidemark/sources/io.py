"""Sources and sinks: event streams, envelopes, relational tables, fan-out, idempotent writes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType



def read_events(spark: SparkSession, source: str, schema: StructType, fmt: str = "kafka", start: str = "earliest", committed: bool = True, options: dict[str, str] | None = None) -> DataFrame:
    """Stream of JSON events: the schema's columns. For Kafka, source is `servers/topic` and start is earliest, latest or
    an epoch in milliseconds; for `text`, a folder of JSON lines; null payloads and rows without a first column go.

    Fields are taken under their snake_case or camelCase names; malformed JSON gives nulls and goes too.
    """
    reader = spark.readStream.format(fmt).options(**(options or {}))
    if fmt == "kafka":
        servers, topic = source.rsplit("/", 1)
        at = {"startingTimestamp": start} if start.isdigit() else {"startingOffsets": start}
        isolation = "read_committed" if committed else "read_uncommitted"
        raw = reader.options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.isolation.level": isolation, **at}).load().select(F.col("value").cast("string"))
    else:
        raw = reader.load(source)
    return parse_events(raw, schema)


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(p.capitalize() for p in rest)


def parse_events(raw: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the schema from the JSON text in `value`."""
    both = StructType(list(schema))
    for f in schema:
        if camel(f.name) != f.name:
            both = both.add(camel(f.name), f.dataType)
    parsed = raw.filter("value IS NOT NULL").select(F.from_json("value", both).alias("v"))
    cols = [F.coalesce(*(F.col("v")[n] for n in dict.fromkeys((f.name, camel(f.name))))).alias(f.name) for f in schema]
    return parsed.select(*cols).filter(F.col(schema[0].name).isNotNull())


def from_position(df: DataFrame, ts: str, start) -> DataFrame:
    """A table read from a timestamp on; the filter reaches the scan."""
    return df.filter(F.col(ts) >= start)


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert stream as a table: the latest row of each key."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__v")).select(*keys, "__v.*")


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str | None = None, partition_column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if driver:
        reader = reader.option("driver", driver)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()


def _jdbc_writer(df: DataFrame, keys: list[str], driver: str | None):
    """Writer whose new tables have comparable text keys."""
    writer = df.write.option("driver", driver) if driver else df.write
    texts = [f.name for f in df.schema if f.name in keys and f.dataType.simpleString() == "string"]
    return writer.option("createTableColumnTypes", ", ".join(f"{c} VARCHAR(255)" for c in texts)) if texts else writer


def insert_jdbc(df: DataFrame, url: str, table: str, driver: str | None = None, keys: list[str] | None = None) -> None:
    """Plain insert: a replay repeats rows, or fails at a primary key."""
    _jdbc_writer(df, keys or [], driver).jdbc(url, table, mode="append")


def upsert_jdbc(df: DataFrame, url: str, table: str, keys: list[str], order: list[str], driver: str | None = None) -> None:
    """Idempotent write by key: the batch's latest rows go to a staging table of its own in parallel, then one set-based
    MERGE takes them over, and the staging table goes, whether that succeeds or not."""
    spark, staging = df.sparkSession, f"{table}_{uuid.uuid4().hex[:12]}".upper()
    last = latest_by_key(df, keys, order)
    other = [c for c in last.columns if c not in keys]
    q = lambda c: f'"{c}"'
    sql = (
        f"MERGE INTO {table} t USING {staging} s ON {' AND '.join(f't.{q(k)} = s.{q(k)}' for k in keys)} "
        f"WHEN MATCHED THEN UPDATE SET {', '.join(f'{q(c)} = s.{q(c)}' for c in other)} "
        f"WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, last.columns))}) VALUES ({', '.join(f's.{q(c)}' for c in last.columns)})"
    )
    jvm = spark.sparkContext._jvm
    if driver:
        jvm.java.lang.Class.forName(driver)
    connection = jvm.java.sql.DriverManager.getConnection(url)
    try:
        _jdbc_writer(last, keys, driver).jdbc(url, staging, mode="overwrite")
        connection.createStatement().executeUpdate(sql)
    finally:
        if connection.getMetaData().getTables(None, None, staging, None).next():
            connection.createStatement().executeUpdate(f"DROP TABLE {staging}")
        connection.close()


def to_key_value(df: DataFrame, key: str) -> DataFrame:
    """key and JSON value of every row, as message sinks take them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_messages(stream: DataFrame, key: str, servers: str, topic: str, checkpoint: str):
    """Keyed JSON messages to a Kafka topic, at least once."""
    return to_key_value(stream, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def discard(df: DataFrame) -> None:
    """Run a plan for its effects; rows go nowhere."""
    df.write.format("noop").mode("overwrite").save()


def fan_out(batch: DataFrame, routes: dict[str, Column], write: Callable[[str, DataFrame], None]) -> None:
    """One input, many outputs: the batch is kept once and each route's rows are written."""
    kept = batch.persist()
    try:
        for name, condition in routes.items():
            write(name, kept.filter(condition))
    finally:
        kept.unpersist()


def write_once(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Sink for foreachBatch that a replay doesn't change: each batch owns one folder, written over by its replay."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def append_log(df: DataFrame, path: str, date: str) -> None:
    """Append to a log table partitioned by date."""
    df.write.mode("append").partitionBy(date).parquet(path)


def replace_table(df: DataFrame, name: str, keys: list[str]) -> None:
    """Create or replace a keyed summary table; repeated keys are refused."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"keys {keys} repeat")
    df.write.mode("overwrite").saveAsTable(name)


def route_envelopes(raw: DataFrame, source: Column, key: Column, fields: Column, schemas: dict[str, StructType], aliases: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Typed rows by source from envelopes (source, key, JSON of fields). The source's case doesn't matter; unknown
    sources and rows without a key or fields are dropped; absent fields are null."""
    name = F.lower(source)
    for short, full in (aliases or {}).items():
        name = F.when(name == short, full).otherwise(name)
    valid = raw.select(name.alias("source"), key.alias("key"), fields.alias("fields")).filter("key IS NOT NULL AND fields IS NOT NULL")
    return {k: valid.filter(F.col("source") == k).select("key", F.from_json("fields", s).alias("f")).select("key", "f.*") for k, s in schemas.items()}


