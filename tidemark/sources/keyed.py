"""Keyed tables on parquet with merge rules, snapshots, a change feed and point lookups.

A table is a folder of files, dealt to buckets by key and sorted by it, and of small manifests. A merge looks for its
batch's keys in the buckets that they fall into, reading key columns only, and rewrites the files that hold one of them;
new keys go into files of their own, and a bucket's small files are joined up once they are many. Publishing one manifest is
its last step, so readers see all of a batch or nothing. The ids of applied batches are in the last manifest: a batch that
was applied already is skipped, whatever the merge rule, so replays change nothing.

Defined cases, for all merge rules: a null key is a key of its own; a row whose order is null counts as the earliest;
rows that tie in their order are decided by their other columns, the greatest winning (the least where the first row
stays), so a merge gives the same table however its rows are dealt. A table may have keys alone, and columns of any name but
the reserved __bucket and __value, and with a feed but op and batch_id, which its change rows have.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, DateType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.functions.expressions import key_bucket

#: Names that a table's columns can't have.
BUCKET, VALUE = "__bucket", "__value"


def _by(*order: str) -> Column:
    """An order that is never null, so rows with null in it aren't lost by max_by and min_by."""
    return F.struct(*order)


def _picked(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Keys and the columns of one struct a key."""
    return rows.groupBy(*keys).agg(value.alias(VALUE)).select(*keys, f"{VALUE}.*")


def merge_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins."""
    others = [c for c in rows.columns if c not in keys]
    return _picked(rows, keys, F.max_by(F.struct(*others), _by(order, *others))) if others else rows.select(*keys).distinct()


def merge_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First write is kept."""
    others = [c for c in rows.columns if c not in keys]
    return _picked(rows, keys, F.min_by(F.struct(*others), _by(order, *others))) if others else rows.select(*keys).distinct()


def merge_versioned(rows: DataFrame, keys: list[str], order: str, version: str) -> DataFrame:
    """The highest version wins, the later write among equals."""
    others = [c for c in rows.columns if c not in keys]
    return _picked(rows, keys, F.max_by(F.struct(*others), _by(version, order, *others))) if others else rows.select(*keys).distinct()


def merge_aggregate(rows: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Columns merge by sum, max or min; nulls don't count."""
    return rows.groupBy(*keys).agg(*(getattr(F, rule)(c).alias(c) for c, rule in rules.items()))


def merge_partial(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], listed: str) -> DataFrame:
    """Each column takes the value of the last write that lists it (`listed`: array of column names), a null included;
    columns that no write lists stay null."""
    value = lambda c: F.max_by(F.struct(F.col(c)), F.when(F.array_contains(listed, c), _by(*order, c)))[c].alias(c)
    return rows.groupBy(*keys).agg(*(value(c) for c in columns))


def join_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which null keys are equal; b's keys get other names, so both may stem from one table."""
    other = b.withColumnsRenamed({k: f"__other_{k}" for k in keys})
    return a.join(other, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__other_{k}")) for k in keys)), how)


def pushed_keys(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """rows filtered by the wanted keys' values, column by column, where the keys are few; all rows otherwise."""
    simple = [k for k in keys if isinstance(rows.schema[k].dataType, AtomicType)]
    found = wanted.select(*simple).limit(PUSHED + 1).collect()
    if len(found) > PUSHED:
        return rows
    for i, key in enumerate(simple):
        values = {r[i] for r in found}
        known = F.col(key).isin(list(values - {None}))
        rows = rows.filter(known | F.col(key).isNull() if None in values else known)
    return rows


def _with(ranges: list[list[int]], number: int) -> list[list[int]]:
    """Ranges of applied batch ids with one more."""
    out: list[list[int]] = []
    for low, high in sorted([*ranges, [number, number]]):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


#: Keys of a lookup that are handed to the scan as values.
PUSHED = 100
#: Rows of a bucket that one task writes, into one file.
ROWS_A_FILE = 2_000_000
#: Files of less than an eighth of that which a bucket may have before a merge that touches it joins them up.
SMALL_FILES = 8


@dataclass
class KeyedTable:
    """engine: last, first, versioned, aggregate or partial. With feed, each merge also writes its change rows."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: list[str]
    engine: str = "last"
    buckets: int = 8
    order: str = "seq"
    version: str = "version"
    rules: dict[str, str] = field(default_factory=dict)
    feed: bool = False

    def __post_init__(self) -> None:
        if clash := ({BUCKET, VALUE} | ({"op", "batch_id"} if self.feed else set())) & set(self.schema.names):
            raise ValueError(f"reserved column names: {', '.join(sorted(clash))}")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path("manifests")):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path("manifests")) if s.getPath().getName().endswith(".json"))

    def _load(self, name: str) -> dict:
        stream = self._fs().open(self._path(f"manifests/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifests(self) -> list[dict]:
        """All published snapshots in order; one small file each."""
        return [self._load(name) for name in self._names()]

    def last(self) -> dict | None:
        """The last snapshot's manifest, the only one that reads and merges of the present table open."""
        names = self._names()
        return self._load(names[-1]) if names else None

    def snapshots(self) -> DataFrame:
        """snapshot_id, batch_id, commit_time (epoch ms), total_record_count."""
        rows = [(m["snapshot_id"], m["batch_id"], m["commit_time"], sum(n for files in m["files"].values() for n in files.values())) for m in self.manifests()]
        return self.spark.createDataFrame(rows, "snapshot_id bigint, batch_id bigint, commit_time bigint, total_record_count bigint")

    def _files(self, manifest: dict | None, buckets: set[int] | None = None) -> DataFrame:
        held = (manifest or {"files": {}})["files"]
        return self._rows([p for b, files in held.items() if buckets is None or int(b) in buckets for p in files])

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in files))

    def _holding(self, files: list[str], keys: DataFrame) -> set[str]:
        """Those of these files that hold one of the keys."""
        if not files:
            return set()
        place = F.regexp_extract(F.input_file_name(), f"data/[0-9]+/{BUCKET}=[^/]+/[^/]+$", 0)
        held = pushed_keys(self._rows(files), keys, self.keys).select(*self.keys, place.alias(BUCKET))
        return {r[0] for r in join_keys(held, keys, self.keys, "left_semi").select(BUCKET).distinct().collect()}

    def _at(self, snapshot: int | None = None, as_of_ms: int | None = None) -> dict | None:
        if snapshot is None and as_of_ms is None:
            return self.last()
        fit = [m for m in self.manifests() if (snapshot is None or m["snapshot_id"] <= snapshot) and (as_of_ms is None or m["commit_time"] <= as_of_ms)]
        return fit[-1] if fit else None

    def read(self, snapshot: int | None = None, as_of_ms: int | None = None) -> DataFrame:
        """The table now, at a snapshot, or as of a time."""
        return self._files(self._at(snapshot, as_of_ms))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys; only buckets that hold one of them are read. Up to PUSHED keys reach the scan too: files are
        sorted by key and have Bloom filters of it, so it skips row groups and pages, and what is read follows the number of keys."""
        own = keys.select(*self.keys).distinct()
        wanted = {r[0] for r in own.select(key_bucket(self._key(), self.buckets).alias("b")).distinct().collect()}
        return join_keys(pushed_keys(self._files(self.last(), wanted), own, self.keys), own, self.keys, "left_semi")

    def _key(self) -> Column:
        return F.struct(*self.keys) if len(self.keys) > 1 else F.col(self.keys[0])

    def _merged(self, current: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
        """Stored rows and a batch's rows by the table's rule."""
        if self.engine == "first":  # what is stored stays, whatever its order
            return current.unionByName(join_keys(merge_first(new, self.keys, self.order), current, self.keys, "left_anti"))
        if self.engine == "partial":
            names = self.schema.names
            others = [c for c in names if c not in self.keys]
            listed = lambda df, fresh, cols: df.select(*names, F.lit(fresh).alias("__fresh"), F.col(self.order).alias("__order"), F.array(*map(F.lit, cols)).cast("array<string>").alias("__listed"))
            writes = listed(current, 0, others).unionByName(listed(new, 1, [c for c in columns if c not in self.keys]))
            return merge_partial(writes, self.keys, ["__fresh", "__order"], others, "__listed")
        rows = current.unionByName(new)
        if self.engine == "versioned":
            return merge_versioned(rows, self.keys, self.order, self.version)
        if self.engine == "aggregate":
            return merge_aggregate(rows, self.keys, self.rules)
        return merge_last(rows, self.keys, self.order)

    def merge(self, batch: DataFrame, batch_id: int, columns: list[str] | None = None, commit_time: int | None = None) -> bool:
        """Apply a batch; False if it was applied before. For partial updates, `columns` are those that the batch writes.
        Only files that hold one of its keys are rewritten; rows are dealt to as many tasks, and files, as their number asks for."""
        last = self.last()
        applied = (last or {}).get("applied", [])
        if any(low <= batch_id <= high for low, high in applied):
            self._show_changes(batch_id)
            return False
        number = 1 + (last["snapshot_id"] if last else 0)
        names, held = self.schema.names, (last or {"files": {}})["files"]
        new = batch.select(*names).withColumn(BUCKET, key_bucket(self._key(), self.buckets)).persist()
        try:
            sizes = {str(r[0]): r[1] for r in new.groupBy(BUCKET).count().collect()}
            touched = new.select(*self.keys).distinct()
            old = self._holding([p for b in sizes for p in held.get(b, {})], touched)
            for b in sizes:
                small = {p for p, n in held.get(b, {}).items() if n < ROWS_A_FILE // 8}
                old |= small if len(small) > SMALL_FILES else set()
            current = self._rows(sorted(old))
            most = max([0, *(n + sum(m for p, m in held.get(b, {}).items() if p in old) for b, n in sizes.items())])
            share, folder = 1 + most // ROWS_A_FILE, f"data/{number:012d}"
            out = self._merged(current, new.select(*names), columns or [])
            dealt = out.select(*names).withColumn(BUCKET, key_bucket(self._key(), self.buckets)).repartition(max(1, len(sizes) * share), BUCKET, F.pmod(F.xxhash64(F.lit(7), *self.keys), F.lit(share)))
            writer = dealt.sortWithinPartitions(BUCKET, *self.keys).write.mode("overwrite").partitionBy(BUCKET)
            for key in (k for k in self.keys if isinstance(self.schema[k].dataType, (IntegerType, LongType, StringType, DateType))):
                writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(max(1, most // share)))
            writer.parquet(f"{self.path}/{folder}")
            if self.feed and sizes:  # only rows of the batch's keys are compared
                after = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").select(*names)
                own = lambda rows: join_keys(rows, touched, self.keys, "left_semi")
                changelog(own(current), own(after), self.keys).write.mode("overwrite").parquet(f"{self.path}/staged/batch_id={batch_id}")
        finally:
            new.unpersist()
        files = {b: {p: n for p, n in own.items() if p not in old} for b, own in held.items()}
        for b, written in (self._written(folder) if sizes else {}).items():
            files[b] = {**files.get(b, {}), **written}
        now = commit_time if commit_time is not None else self.spark.sql("SELECT unix_millis(current_timestamp())").first()[0]
        manifest = {"snapshot_id": number, "batch_id": batch_id, "commit_time": now, "files": files, "applied": _with(applied, batch_id)}
        self._publish(f"manifests/{number:012d}.json", json.dumps(manifest))
        self._show_changes(batch_id)
        return True

    def _show_changes(self, batch_id: int) -> None:
        """Rename the change rows of a published batch to where streams look. Where a driver is lost before that, the
        batch's replay does it, so a stream meets each batch's changes once."""
        fs, staged = self._fs(), self._path(f"staged/batch_id={batch_id}")
        if self.feed and fs.exists(staged):
            fs.mkdirs(self._path("changes"))
            if not fs.rename(staged, self._path(f"changes/batch_id={batch_id}")):
                raise RuntimeError(f"changes of batch {batch_id} can't be moved")

    def change_stream(self) -> DataFrame:
        """op, the table's columns and batch_id of the change rows of all merges, as a stream."""
        self._fs().mkdirs(self._path("changes"))
        schema = StructType([StructField("op", StringType()), *self.schema, StructField("batch_id", LongType())])
        return self.spark.readStream.schema(schema).parquet(f"{self.path}/changes")

    def _written(self, folder: str) -> dict[str, dict[str, int]]:
        """Rows of each file that a snapshot has written, by bucket."""
        out: dict[str, dict[str, int]] = {}
        rows = self.spark.read.parquet(f"{self.path}/{folder}").groupBy(BUCKET, F.input_file_name().alias(VALUE)).count()
        for bucket, name, n in rows.collect():
            out.setdefault(str(bucket), {})[f"{folder}/{BUCKET}={bucket}/{name.rsplit('/', 1)[1]}"] = n
        return out

    def _publish(self, name: str, text: str) -> None:
        """Write aside, then rename: the manifest is there whole or not at all."""
        fs = self._fs()
        fs.mkdirs(self._path("manifests"))
        stream = fs.create(self._path(f"{name}.tmp"), True)
        stream.write(text.encode())
        stream.close()
        if not fs.rename(self._path(f"{name}.tmp"), self._path(name)):
            raise RuntimeError(f"{name} is published already")

    def expire(self, older_than_ms: int, keep: int = 1) -> int:
        """Forget snapshots committed before a time, but for the last `keep`, and the files that only they hold. The ids of
        all applied batches stay known."""
        all_, fs = self.manifests(), self._fs()
        gone = [m for m in all_[: len(all_) - keep] if m["commit_time"] < older_than_ms]
        of = lambda m: {p for files in m["files"].values() for p in files}
        held = {p for m in all_ if m not in gone for p in of(m)}
        for m in gone:
            fs.delete(self._path(f"manifests/{m['snapshot_id']:012d}.json"), False)
        for path in {p for m in gone for p in of(m)} - held:
            fs.delete(self._path(path), True)
        return len(gone)

    def changes(self, since: int = 0) -> DataFrame:
        """op (+I, -U, +U) and rows that turn the snapshot `since` into the present table."""
        return changelog(self.read(snapshot=since) if since else self.spark.createDataFrame([], self.schema), self.read(), self.keys)


def changelog(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """op and the row: +I for new keys, -U with the old and +U with the new row of changed ones, -D for gone keys."""
    others = [c for c in after.columns if c not in keys]
    row = lambda name: F.struct(F.lit(True).alias(VALUE), *others).alias(name)
    b, a = before.select(*keys, row("__old")), after.select(*keys, row("__new"))
    both = join_keys(b, a, keys, "full_outer").filter(~F.col("__old").eqNullSafe(F.col("__new")))
    both = both.select(*(F.coalesce(k, f"__other_{k}").alias(k) for k in keys), "__old", "__new")
    change = lambda op, v: F.struct(F.lit(op).alias("op"), F.col(v).alias("v"))
    ops = F.when(F.col("__old").isNull(), F.array(change("+I", "__new"))).when(F.col("__new").isNull(), F.array(change("-D", "__old")))
    ops = ops.otherwise(F.array(change("-U", "__old"), change("+U", "__new")))
    return both.select(*keys, F.explode(ops).alias("__change")).select("__change.op", *keys, "__change.v.*").drop(VALUE)
