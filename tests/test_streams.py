"""Streams over several batches: fresh dimensions, as-of history, windows of arrival, revised joins; and odd names in keyed tables."""

import datetime as dt
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import accumulators, joins
from tidemark.sources import keyed, tier
from tidemark.streaming import refresh, rejects, revise, run, stateful
from tidemark.workdir import scratch


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.mark.parametrize("bucket", [None, "floor(unix_seconds(__ts) / 50)"])
def test_asof_of_null_times(spark, bucket):
    left = spark.createDataFrame([(1, "a", at(100)), (2, "c", None), (3, "b", at(5))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", None, 1.0), ("c", None, 3.0), ("b", at(1), 2.0), ("b", None, 9.0)], "k string, rt timestamp, v double")
    out = joins.asof_join(left, right, ["k"], "t", "rt", ["v"], bucket=bucket and F.expr(bucket))
    assert rows(out.select("id", "v"), "id") == [(1, None), (2, None), (3, 2.0)]


# processors, with states and timers held here


class Held:
    """States, timers and the clock of one key."""

    def __init__(self):
        self.now, self.timers = 0, set()

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, *schema):
        return Map()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)

    def listTimers(self):
        return iter(sorted(self.timers))

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.expiry

    def fire(self, processor, key, now):
        self.now, out = now, []
        for t in sorted(t for t in self.timers if t <= now):
            self.timers.discard(t)
            self.expiry = t
            out += processor.handleExpiredTimer(key, self, self)
        return out


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = tuple(value)

    def clear(self):
        self.held = None


class Map(dict):
    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


def processor(kind, *args, **more):
    held, p = Held(), kind(*args, **more)
    p.init(held)
    return held, p


def asof(p, held, *events):
    rows = [{"side": side, "ms": ms, "row": str(ms) if side == "left" else None, "value": value} for side, ms, value in events]
    return [(r["row"], r["value_ms"], r["value"]) for r in p.handleInputRows(("k",), iter(rows), held)]


def test_asof_history_answers_late_rows():
    held, p = processor(stateful.AsOfHistory, delay_ms=10, retain_ms=100, wait_ms=20, bucket_ms=10)
    right = lambda ms, v: ("right", ms, v)
    left = lambda ms: ("left", ms, None)
    assert asof(p, held, right(5, 1.0), right(40, 2.0), left(25), left(31), ("left", None, None)) == [("None", None, None), ("25", 5, 1.0)]  # the clock is at 30
    assert asof(p, held, right(62, 3.0), left(60)) == [("31", 5, 1.0)] and asof(p, held, right(75, 4.0)) == [("60", 40, 2.0)]
    held, p = processor(stateful.AsOfHistory, delay_ms=10, retain_ms=100, wait_ms=20, bucket_ms=10)
    assert asof(p, held, right(5, 1.0), right(40, 2.0), left(20), left(38)) == [("20", 5, 1.0)]  # clock 30
    assert asof(p, held, right(33, 1.5), right(60, 3.0)) == [("38", 33, 1.5)]  # a late rate counts while the row waits
    assert asof(p, held, left(34)) == [("34", 33, 1.5)]  # late itself
    held, p = processor(stateful.AsOfHistory, delay_ms=0, retain_ms=100, wait_ms=20, bucket_ms=10)
    assert asof(p, held, right(50, 1.0), left(30)) == [("30", None, None)]  # 20 behind: its wait is over
    assert asof(p, held, left(45)) == [] and asof(p, held, right(44, 0.9)) == [("45", 44, 0.9)]
    assert asof(p, held, left(41)) == [] and asof(p, held, right(61, 1.1)) == [("41", None, None)]


def test_asof_history_keeps_the_youngest_before_its_horizon():
    held, p = processor(stateful.AsOfHistory, delay_ms=0, retain_ms=100, wait_ms=0, bucket_ms=10)
    asof(p, held, ("right", 5, 1.0), ("right", 15, 2.0), ("right", 18, 3.0))
    asof(p, held, ("right", 1000, 4.0))
    assert set(p.rights) == {(100,)} and p.older.get() == (18, 3.0)
    assert asof(p, held, ("left", 500, None), ("left", 17, None)) == [("17", None, None), ("500", 18, 3.0)]


def test_asof_history_late_value_behind_a_younger_one_that_left_the_horizon():
    held, p = processor(stateful.AsOfHistory, delay_ms=0, retain_ms=100, wait_ms=20, bucket_ms=10)
    asof(p, held, ("right", 18, 3.0))
    asof(p, held, ("right", 1000, 4.0))
    assert asof(p, held, ("right", 5, 1.0), ("left", 7, None), ("left", 17, None), ("left", 500, None)) == [("7", 5, 1.0), ("17", 5, 1.0), ("500", 18, 3.0)]


class Counted(Held):
    """A handle of the store that counts what is asked of it."""

    calls = 0

    def getValueState(self, name, schema):
        state = Value()
        for call in ("exists", "get", "update", "clear"):
            setattr(state, call, self.counted(getattr(state, call)))
        return state

    def counted(self, call):
        def ask(*args):
            self.calls += 1
            return call(*args)

        return ask

    def getCurrentWatermarkInMs(self):
        return self.now


def test_keys_of_a_bucket_share_one_value_of_the_store():
    """Each of 500 keys (null, text and numbers) gets what it gets by itself, for as many messages as one key needs."""
    keys = [None, "a", 1.5, float("nan"), 0.0, *range(495)]
    events = [[("right", 10 + i % 7, float(i)) for i in range(k % 4)] + [("left", 5 + k % 13, None), ("left", 30, None)] for k in range(len(keys))]
    held, p = Counted(), stateful.ManyKeys(stateful.AsOf(10), "key", "EventTime")
    p.init(held)
    record = lambda k, n, e: Row("bucket", "key", "side", "ms", "row", "value")(0, k, e[0], e[1], f"{n}" if e[0] == "left" else None, e[2])
    rows_ = [record(k, n, e) for n, k in enumerate(keys) for e in events[n]]
    assert list(p.handleInputRows((0,), iter(sorted(rows_, key=lambda r: r.ms)), held)) == [] and held.calls == 2 and held.timers == {5}
    got = held.fire(p, (0,), 25)
    assert held.calls == 4 and held.timers == {30}
    got += held.fire(p, (0,), 100)
    assert not held.timers and held.calls == 6
    for n, k in enumerate(keys):
        alone, one = processor(stateful.AsOf, 10)
        one.handleInputRows((k,), iter([record(k, n, e) for e in events[n]]), alone)
        assert [(r["ms"], r["value"]) for r in got if r["row"] == str(n)] == [(r["ms"], r["value"]) for r in alone.fire(one, (k,), 100)]
    assert sum(r["key"] is None for r in got) == 2 and sum(r["key"] != r["key"] for r in got) == 2


def test_a_key_that_holds_nothing_goes_from_its_bucket():
    held, p = Counted(), stateful.ManyKeys(stateful.FirstWithinTtl("ms", 10), "k", "EventTime")
    p.init(held)
    rows_ = [Row("bucket", "k", "ms")(0, k, k) for k in range(3)]
    assert [tuple(r) for r in p.handleInputRows((0,), iter(rows_), held)] == [(0, 0), (1, 1), (2, 2)] and held.timers == {10}
    assert [tuple(r) for r in p.handleInputRows((0,), iter([Row("bucket", "k", "ms")(0, 0, 10)]), held)] == [(0, 10)] and held.timers == {11}
    held.fire(p, (0,), 19)
    assert list(p._read()[1]) == [0] and held.timers == {20}
    held.fire(p, (0,), 20)
    assert p._read() == (None, {}) and not held.timers


def test_asof_history_longest_wait_by_the_clock():
    held, p = processor(stateful.AsOfHistory, delay_ms=10, retain_ms=100, wait_ms=1000, bucket_ms=10, wait_clock_ms=500)
    held.now = 10_000
    assert asof(p, held, ("left", 50, None), ("right", 45, 1.0)) == []
    held.now = 10_200
    assert asof(p, held, ("left", 52, None)) == []
    assert held.fire(p, ("k",), 10_499) == []
    assert [(r["row"], r["value"]) for r in held.fire(p, ("k",), 10_500)] == [("50", 1.0)]
    assert [(r["row"], r["value"]) for r in held.fire(p, ("k",), 10_700)] == [("52", 1.0)]
    assert not p.lefts and not held.timers


def test_arrivals_of_one_window_are_one_row():
    held, p = processor(stateful.ArrivalCount, 1000)
    count = lambda n, now: (setattr(held, "now", now), [tuple(r) for r in p.handleInputRows(("k",), iter(range(n)), held)])[1]
    assert count(2, 5100) == [] and count(3, 5900) == []
    assert [tuple(r) for r in held.fire(p, ("k",), 6000)] == [("k", 5000, 6000, 5)]
    assert count(1, 6500) == [] and count(4, 8200) == [("k", 6000, 7000, 1)]  # the timer came too late
    assert [tuple(r) for r in held.fire(p, ("k",), 9000)] == [("k", 8000, 9000, 4)] and not held.timers


def test_arrivals_are_counted_before_they_reach_the_state(spark, monkeypatch):
    df = spark.range(0, 60_000, 1, 3).select(F.when(F.col("id") % 7 > 0, F.col("id") % 1000).alias("key"))
    for most in (stateful.HELD_ROWS, 300):
        monkeypatch.setattr(stateful, "HELD_ROWS", most)
        packed = [(r[0], stateful._unpacked(r[1])) for r in stateful.counted_by_bucket(df).collect()]
        assert most == 300 or len(packed) == 3 * len({b for b, _ in packed})
        total = stateful._summed([t for _, t in packed], ["key"])
        assert dict(zip(total["key"].to_pylist(), total["n"].to_pylist(), strict=True)) == {r[0]: r[1] for r in df.groupBy("key").count().collect()}


def test_arrivals_of_a_bucket_are_windows_of_all_its_keys(spark, tmp_path):
    for kind in ("bigint", "string", "double"):
        spark.range(0, 5000, 1, 4).select(F.when(F.col("id") % 9 > 0, F.col("id") % 700).cast(kind).alias("k")).write.parquet(f"{tmp_path}/{kind}/in")
        stream = spark.readStream.schema(f"k {kind}").parquet(f"{tmp_path}/{kind}/in")
        plan = stateful.arrival_count_stream(stream, "k", 500)
        run.run_for(plan, "arrivals", 5000, f"{tmp_path}/{kind}/out", f"{tmp_path}/{kind}/state", lambda done: (done.agg(F.sum("n")).first()[0] or 0) == 5000, 90)
        found = spark.read.parquet(f"{tmp_path}/{kind}/out")
        assert found.schema.simpleString() == f"struct<key:{kind},start_ms:bigint,end_ms:bigint,n:bigint>"
        assert not found.filter("end_ms - start_ms <> 500 OR start_ms % 500 <> 0").count() and found.select("key", "start_ms").distinct().count() == found.count()
        own = spark.read.parquet(f"{tmp_path}/{kind}/in").groupBy("k").count()
        assert rows(found.groupBy("key").agg(F.sum("n").alias("n")), "key", "n") == rows(own, "k", "count")


def test_replay_splits_by_arrival_otherwise_than_by_event_time(spark):
    """Rows of one event-time window that arrive in two windows of the clock are two rows; by event time always one."""
    events = [(1, at(0)), (1, at(1)), (1, at(2))]
    held, p = processor(stateful.ArrivalCount, 1000)
    out = []
    for k, _ in enumerate(events):
        held.now = 1500 * k
        out += p.handleInputRows(("k",), iter([0]), held)
    out += held.fire(p, ("k",), 10_000)
    assert [r["n"] for r in out] == [1, 1, 1]
    df = spark.createDataFrame(events, "k int, ts timestamp")
    assert [r.n for r in df.groupBy("k", F.window("ts", "10 seconds")).agg(F.count(F.lit(1)).alias("n")).collect()] == [3]


def test_waits_end_by_the_clock(spark, tmp_path):
    """A left row whose key gets nothing more comes out after the longest wait."""
    spark.createDataFrame([("a", at(10), "r", 1.5), ("a", at(12), "t", None), ("b", at(12), "t", None)], "c string, ts timestamp, kind string, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("c string, ts timestamp, kind string, v double").parquet(f"{tmp_path}/in")
    plan = stateful.asof_history_stream(stream.filter("kind = 't'"), stream.filter("kind = 'r'"), "c", "ts", "v", 60_000, 60_000, 60_000, 10_000, wait_clock_ms=1000)
    run.run_for(plan, "waits", 3, f"{tmp_path}/out", f"{tmp_path}/state", lambda done: done.count() == 2, 90)
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("key", "value"), "key") == [("a", 1.5), ("b", None)]


def test_store_forgets_after_its_ttl(spark, tmp_path):
    """A repeat within the store's TTL goes, one after it is passed, and the store holds no more rows than live keys."""
    schema = "k bigint, t bigint"
    put = lambda name, *data: spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    put("a", (1, 1), (1, 0), (2, 1), (3, 1))
    once = lambda rows, until=None: run.run_for(stateful.dedup_store_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), "k", "t", 8000), "store", rows, f"{tmp_path}/out", f"{tmp_path}/state", until, 90)
    passed = lambda: rows(spark.read.parquet(f"{tmp_path}/out"), "k", "t")
    held = once(4, lambda done: done.count() == 3)[-1]["stateOperators"][0]["numRowsTotal"]
    assert passed() == [(1, 0), (2, 1), (3, 1)]
    time.sleep(9)
    put("b", (1, 7), (1, 8))
    after = once(2, lambda done: done.count() == 4)[-1]["stateOperators"][0]["numRowsTotal"]
    assert passed() == [(1, 0), (1, 7), (2, 1), (3, 1)] and after < held


class Plain:
    """An accumulator of sums, to compare with a built-in one."""

    def create(self):
        return 0.0

    def add(self, state, values):
        return state + float(values.sum())

    def merge(self, a, b):
        return a + b

    def result(self, state):
        return state


def test_accumulators_merge_before_the_shuffle(spark, monkeypatch):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    data = spark.range(20_000).select((F.col("id") % 7 * (F.col("id") % 3 > 0).cast("int")).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id") * 1.0).alias("v")).unionByName(spark.createDataFrame([(None, 2.0), (None, None), (99, None)], "k bigint, v double")).repartition(5)
    out = accumulators.accumulate(data, "k", "v", Plain(), "s")
    assert rows(out, "k") == rows(data.groupBy("k").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("s")), "k")
    largest = {r.k: r.m for r in accumulators.accumulate(data, "k", "v", accumulators.LargestMean(3), "m").collect()}
    by_key = {}
    for k, v in data.collect():
        by_key.setdefault(k, []).extend([] if v is None else [v])
    assert largest == {k: (sum(sorted(v)[-3:]) / len(sorted(v)[-3:]) if v else None) for k, v in by_key.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow")


class Adds(Plain):
    """Counts the calls of add."""

    def add(self, state, values):
        return state + 1


def test_accumulators_add_many_arrow_batches_at_once(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    data = spark.range(0, 100_000, 1, 1).select((F.col("id") % 9).alias("k"), F.col("id").alias("v"))
    assert {r.s for r in accumulators.accumulate(data, "k", "v", Adds(), "s").collect()} == {1.0}


def test_joins_of_streams_keep_one_store_and_old_checkpoints_go_on(spark, tmp_path):
    """A join begun by run_to_parquet keeps its state in format 3; one begun with four stores goes on with them."""
    one = lambda k: spark.createDataFrame([(k, at(10 * k), "a"), (k - 1, at(10 * k), "b")], "k int, ts timestamp, side string").write.parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema("k int, ts timestamp, side string").parquet(f"{tmp_path}/in/*").withWatermark("ts", "1 hour")
    side = lambda name: stream().filter(F.col("side") == name).select("k", F.col("ts").alias(f"t{name}"))
    plan = lambda: joins.interval_join(side("a"), side("b"), ["k"], "ta", "tb", "-1 hours", "1 hours")
    begun = lambda folder: next(tmp_path.glob(f"{folder}/offsets/0")).read_text()
    one(1)
    spark.conf.set(run.PROVIDER, run.ROCKS)
    try:
        plan().writeStream.format("parquet").option("path", f"{tmp_path}/old-out").option("checkpointLocation", f"{tmp_path}/old").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(run.PROVIDER)
    run.run_to_parquet(plan(), "new", checkpoint=f"{tmp_path}/new", out=f"{tmp_path}/new-out")
    assert '"spark.sql.streaming.join.stateFormatVersion":"3"' in begun("new") and '"spark.sql.streaming.join.stateFormatVersion":"3"' not in begun("old")
    assert all(spark.conf.get(k, None) != v for k, v in run.ROCKS_SETTINGS.items())
    one(2)
    for name in ("old", "new"):
        out = run.run_to_parquet(plan(), name, checkpoint=f"{tmp_path}/{name}", out=f"{tmp_path}/{name}-out")
        assert [r.k for r in out.collect()] == [1]


def test_rejects_by_reason(spark):
    schema = StructType.fromDDL("event_id bigint, value double")
    texts = ['{"eventId": 1, "value": 2.5}', '{"event_id": 2}', None, "", "  ", "{", "[]", '{"eventId": "x"}', '{"value": 1}', "{}"]
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    good, seen = rejects.parse_counted(raw, schema, "m")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 2.5), (2, None)]
    assert seen.get["empty"] == 3 and seen.get["good"] == 2 and seen.get["malformed"] + seen.get["no_key"] == 5


def test_replayed_tiering_copies_nothing_twice(spark):
    """A batch that broke off between its rows and its offsets, or after both, gives the same rows when it runs again."""
    cold, now = scratch(spark, "cold"), F.lit("2024-01-01").cast("timestamp")
    batches = [spark.createDataFrame([(i, i % 2) for i in range(a, b)], "id bigint, b int") for a, b in ((0, 10), (10, 10), (10, 25))]
    for i, batch in enumerate(batches):
        tier.copy_batch(batch, i, cold, F.col("b"), ["id"], now)
    before = rows(tier.cold_tier(spark, cold), "__bucket", "__offset")
    tier.copy_batch(batches[2], 2, cold, F.col("b"), ["id"], now)
    assert rows(tier.cold_tier(spark, cold), "__bucket", "__offset") == before
    assert [r[4] for r in before] == [*range(13), *range(12)]


# dimensions


def test_dimension_is_read_again_after_its_interval_only(spark):
    now, version, fail = [0.0], [1], [False]

    def load():
        if fail[0]:
            raise OSError("gone")
        return spark.createDataFrame([(1, version[0])], "k int, v int")

    dim = refresh.RefreshedDimension(spark, load, every_s=60, clock=lambda: now[0])
    value = lambda: dim.current().first().v
    assert value() == 1
    first, version[0], now[0] = dim.path, 2, 59.9
    assert value() == 1 and dim.loads == 1 and dim.path == first
    now[0] = 60.0
    assert value() == 2 and dim.loads == 2
    with pytest.raises(Exception):
        spark.read.parquet(first)  # what was replaced is gone
    now[0], fail[0] = 200.0, True
    with pytest.raises(OSError):
        dim.current()
    fail[0] = False
    assert value() == 2
    dim.release()


def test_small_stops_at_the_bound(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    assert joins.small(spark.range(10)) and not joins.small(spark.range(11))


def test_revised_join_replays(spark):
    facts = StructType.fromDDL("id bigint, k bigint")
    table = StructType.fromDDL("k bigint, tier string, v string")
    join = revise.RevisedJoin(spark, scratch(spark, "revised"), facts, table, ["k"], buckets=2)
    batch = lambda new, changed: join.input(spark.createDataFrame(new, facts), spark.createDataFrame(changed, "op string, k bigint, tier string, v string, batch_id bigint"))
    steps = [
        batch([(1, 7), (2, 8), (3, None)], [("+I", 7, "A", "x", 0), ("+I", None, "N", "x", 0)]),
        batch([(4, 7)], [("-U", 7, "A", "x", 1), ("+U", 7, "B", "x", 1), ("-U", 7, "B", "x", 2), ("+U", 7, "C", "x", 2), ("+I", 8, "D", "y", 2)]),
        batch([(5, 8), (5, 8)], [("+U", 7, "C", "x", 3)]),
    ]
    for i, step in enumerate(steps):
        join.each(step, i)
        before = rows(join.log(), "batch_id", "id", "op", "tier")
        join.each(step, i)  # the batch runs again after its table was merged
        assert rows(join.log(), "batch_id", "id", "op", "tier") == before
    log = [(r.batch_id, r.op, r.id, r.tier) for r in join.log().orderBy("batch_id", "id", "op").collect()]
    assert log == [(0, "+I", 1, "A"), (1, "+U", 1, "C"), (1, "-U", 1, "A"), (1, "+I", 2, "D"), (1, "+I", 4, "C"), (2, "+I", 5, "D"), (2, "+I", 5, "D")]
    assert rows(revise.folded(join.log(), 2).select("id", "tier"), "id") == [(1, "C"), (2, "D"), (4, "C"), (5, "D"), (5, "D")]


# keyed tables


@pytest.mark.parametrize("engine", ["last", "first", "versioned", "partial"])
def test_keyed_table_of_odd_names(spark, engine):
    data = spark.createDataFrame([(1, "x", "p", 1, 1), (2, "y", "q", 2, 2)], "v int, bucket string, op string, seq int, version int")
    table = keyed.KeyedTable(spark, scratch(spark, "odd"), data.schema, ["v"], engine, buckets=3)
    with pytest.raises(ValueError):
        keyed.KeyedTable(spark, "x", data.schema, ["v"], engine, feed=True)
    table.merge(data, 0, ["bucket", "op", "seq", "version"])
    table.merge(data.filter("v = 1").withColumns({"bucket": F.lit("z"), "seq": F.lit(3), "version": F.lit(3)}), 1, ["bucket", "op", "seq", "version"])
    first = "x" if engine == "first" else "z"
    assert rows(table.read().select("v", "bucket", "op"), "v") == [(1, first, "p"), (2, "y", "q")]


def test_keyed_table_keyed_by_bucket_and_of_keys_alone(spark):
    data = spark.createDataFrame([("a", 1), ("b", 2)], "bucket string, seq int")
    table = keyed.KeyedTable(spark, scratch(spark, "odd"), data.schema, ["bucket"], buckets=3)
    table.merge(data, 0)
    assert rows(table.read(), "bucket") == [("a", 1), ("b", 2)]
    alone = keyed.KeyedTable(spark, scratch(spark, "alone"), data.schema, ["bucket", "seq"], buckets=3, feed=True)
    for i in range(2):
        alone.merge(data.unionByName(data), i)
    assert rows(alone.read(), "bucket") == [("a", 1), ("b", 2)]
    assert rows(run.run_to_parquet(alone.change_stream(), "alone"), "bucket") == [("+I", "a", 1, 0), ("+I", "b", 2, 0)]
    with pytest.raises(ValueError):
        keyed.KeyedTable(spark, "x", StructType.fromDDL("k int, __value int"), ["k"])


def scanned(df):
    """Rows that the scans of a plan have given."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookup_reads_what_its_keys_ask_for(spark):
    """Rows scanned follow the number of keys, not the table; more keys than are pushed, and null keys, give the same rows."""
    data = spark.range(300_000).select((F.col("id") * 3).alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v"), F.lit(1).alias("seq")).unionByName(spark.createDataFrame([(None, "none", 1)], "k bigint, v string, seq int"))
    table = keyed.KeyedTable(spark, scratch(spark, "pushed"), data.schema, ["k"], buckets=1)
    table.merge(data, 0)
    wanted = spark.createDataFrame([(30,), (300_000,), (31,), (None,)], "k bigint")
    assert rows(table.lookup(wanted).select("k", "v"), "k") == [(None, "none"), (30, "v10"), (300_000, "v100000")]
    many = spark.range(0, 900, 3).select(F.col("id").alias("k"))
    assert table.lookup(many).count() == 300 > keyed.PUSHED
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one, all_ = scanned(keyed.pushed_keys(table.read(), wanted.limit(1), ["k"])), scanned(table.read())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert all_ == 300_001 and one <= 20_000


def files_of(table):
    return {p for files in table.last()["files"].values() for p in files}


def test_merges_rewrite_files_that_hold_their_keys(spark, monkeypatch):
    """One key's merge rewrites one file, new keys rewrite none, small files are joined up once they are many."""
    monkeypatch.setattr(keyed, "ROWS_A_FILE", 200)
    table = keyed.KeyedTable(spark, scratch(spark, "by_file"), StructType.fromDDL("k bigint, v string, seq bigint"), ["k"], buckets=1)
    table.merge(spark.range(1000).selectExpr("id k", "concat('v', id) v", "0L seq"), 0)
    before = files_of(table)
    table.merge(spark.range(7, 8).selectExpr("id k", "'new' v", "1L seq"), 1)
    after = files_of(table)
    assert len(before) >= 5 and len(before - after) == len(after - before) == 1
    for i in range(keyed.SMALL_FILES + 2):
        table.merge(spark.range(2000 + i, 2001 + i).selectExpr("id k", "'late' v", "1L seq"), 2 + i)
        assert before - {*(before - after)} <= files_of(table)
    assert len(files_of(table) - after) <= 2  # the small ones in one, and the one since
    got = {r.k: r.v for r in table.read().collect()}
    assert got == {**{i: f"v{i}" for i in range(1000)}, 7: "new", **{2000 + i: "late" for i in range(keyed.SMALL_FILES + 2)}}
    assert table.snapshots().orderBy("snapshot_id").collect()[-1].total_record_count == len(got) == table.read().count()


@pytest.mark.parametrize("engine", ["last", "first", "versioned", "aggregate", "partial"])
def test_merges_in_parts_equal_one_merge(spark, monkeypatch, engine):
    """Batches over many files, of two key columns with nulls among them; the feed folds to the table."""
    monkeypatch.setattr(keyed, "ROWS_A_FILE", 40)
    monkeypatch.setattr(keyed, "SMALL_FILES", 2)
    every = spark.range(400).selectExpr("nullif(pmod(hash(id), 61), 5) a", "nullif(concat('s', pmod(hash(id, 1), 3)), 's1') b", "id seq", "pmod(hash(id, 2), 50) version", "id * 3 v")
    table = keyed.KeyedTable(spark, scratch(spark, engine), every.schema, ["a", "b"], engine, buckets=2, rules={"seq": "max", "version": "min", "v": "sum"}, feed=True)
    listed = ["seq", "version", "v"]
    for i, (low, high) in enumerate([(0, 200), (200, 201), (201, 330), (330, 332), (332, 400)]):
        table.merge(every.filter(f"seq >= {low} AND seq < {high}"), i, listed)
    if engine == "partial":
        expected = keyed.merge_last(every, ["a", "b"], "seq")
    else:
        plain = {"last": lambda: keyed.merge_last(every, ["a", "b"], "seq"), "first": lambda: keyed.merge_first(every, ["a", "b"], "seq")}
        plain |= {"versioned": lambda: keyed.merge_versioned(every, ["a", "b"], "seq", "version"), "aggregate": lambda: keyed.merge_aggregate(every, ["a", "b"], table.rules)}
        expected = plain[engine]()
    out = lambda df: sorted(map(tuple, df.select(*every.columns).collect()), key=str)
    assert out(table.read()) == out(expected)
    wanted = spark.createDataFrame([(None, "s2"), (3, None), (99, "s0")], "a int, b string")
    assert out(table.lookup(wanted)) == [r for r in out(expected) if r[:2] in {(None, "s2"), (3, None)}]
    log = spark.read.parquet(f"{table.path}/changes")
    net = log.groupBy(*every.columns).agg(F.sum(F.when(F.col("op").startswith("+"), 1).otherwise(-1)).alias("n")).filter("n <> 0")
    assert out(net) == out(expected) and {r.n for r in net.collect()} == {1}
