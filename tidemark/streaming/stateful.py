"""Stateful processors for what native streaming joins and dedup can't say: exact TTL, one row a key, as-of history.

In event time a run over bounded input ends and a replay gives the same rows. State is kept by key and ends by timers:
what a key holds is bounded by its TTL, by one match, or by what the watermark hasn't passed yet. A key's rows of one
micro-batch are held at once, so bound micro-batches (maxFilesPerTrigger) where keys are hot. Rows without a time take
no part. run.start() sets the state store that these processors need.

A processor is written for one key. Each call to the state store is a message between Python and the JVM, so ManyKeys runs a
processor for all keys of a hash bucket over one value of the store: messages grow with buckets, not with keys and rows.
"""

from __future__ import annotations

import json
import pickle
import sys
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructType


# Processors travel with their code, so Python workers needn't be able to import this package.
register_pickle_by_value(sys.modules[__name__])

#: Hash buckets of keys. A micro-batch reads and writes the state of each bucket that it meets, so more buckets suit many
#: millions of keys in small micro-batches. A checkpoint keeps to the number that it began with.
BUCKETS = 1024
#: Rows that a task holds at most before it counts them, and keys with counts before it gives them on.
HELD_ROWS = 1 << 18


class FirstWithinTtl(StatefulProcessor):
    """Passes a key's first row; repeats go until ttl_ms after the row that was passed, and are passed then. A key's state
    ends when the watermark is so far."""

    def __init__(self, time: str, ttl_ms: int):
        self.time, self.ttl_ms = time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = last = self.passed.get()[0] if self.passed.exists() else None
        for row in sorted(rows, key=lambda r: r[self.time]):
            if last is None or row[self.time] - last >= self.ttl_ms:
                last = row[self.time]
                yield row
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl_ms)
            self.passed.update((last,))
            self.handle.registerTimer(last + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.passed.clear()
        return iter(())

    def close(self) -> None:
        pass


class FirstOfStore(StatefulProcessor):
    """Passes a key's first row; repeats go as long as the state store holds the key, which it forgets ttl_ms of processing
    time after it was met first. Repeats don't prolong that, and no timer of one's own is kept."""

    def __init__(self, time: str, ttl_ms: int):
        self.time, self.ttl_ms = time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.met = handle.getValueState("met", "there boolean", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.met.exists():
            self.met.update((True,))
            yield min(rows, key=lambda r: (r[self.time] is None, r[self.time]))

    def close(self) -> None:
        pass


class RunningCount(StatefulProcessor):
    """Adds the number of the key's rows so far."""

    def __init__(self, time: str):
        self.time = time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        for row in sorted(rows, key=lambda r: r[self.time]):
            n += 1
            yield Row(**row.asDict(), n=n)
        self.count.update((n,))

    def close(self) -> None:
        pass


class MatchOrOrphan(StatefulProcessor):
    """One row a key of a left and a right stream: INNER on the first match, else LEFT_ORPHAN or RIGHT_ORPHAN once the
    clock is timeout_ms past the row. Later rows of a finished key give nothing until ttl_ms has passed. The clock is the
    watermark, or the processing time; then rows count from their arrival."""

    def __init__(self, timeout_ms: int, ttl_ms: int, processing_time: bool = False):
        self.timeout_ms, self.ttl_ms, self.processing_time = timeout_ms, ttl_ms, processing_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "side string, ms bigint, value string")
        self.done = handle.getValueState("done", "ms bigint")

    def _row(self, key, kind: str, left: str | None, right: str | None) -> Row:
        return Row(key=key[0], join_kind=kind, left_value=left, right_value=right)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.done.exists():
            return
        held = tuple(self.waiting.get()) if self.waiting.exists() else None
        for row in sorted(rows, key=lambda r: (r["ms"], r["side"])):
            ms = timerValues.getCurrentProcessingTimeInMs() if self.processing_time else row["ms"]
            if held is None:
                held = (row["side"], ms, row["value"])
                self.handle.registerTimer(ms + self.timeout_ms)
            elif ms - held[1] > self.timeout_ms:  # its deadline has passed, whether or not the watermark shows it yet
                yield self._orphan(key, held)
                return
            elif held[0] != row["side"]:
                left, right = (held[2], row["value"]) if held[0] == "left" else (row["value"], held[2])
                self._finish(max(held[1], ms))
                yield self._row(key, "INNER", left, right)
                return
        self.waiting.update(held)

    def _orphan(self, key, held) -> Row:
        side, ms, value = held
        self._finish(ms + self.timeout_ms)
        return self._row(key, "LEFT_ORPHAN", value, None) if side == "left" else self._row(key, "RIGHT_ORPHAN", None, value)

    def _finish(self, ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.waiting.clear()
        self.done.update((ms,))
        self.handle.registerTimer(ms + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.done.exists():
            self.done.clear()
            return
        if self.waiting.exists():
            yield self._orphan(key, tuple(self.waiting.get()))

    def close(self) -> None:
        pass


class AsOf(StatefulProcessor):
    """Joins each left row with the latest right value at or before its time (the largest of equals), once the watermark
    has passed that time, so a late right row can't change the answer and no row waits longer than the watermark's delay.

    Left rows wait by their time, right values by time buckets. A timer reads the rows of its own time and one bucket; at
    a bucket's end its youngest value is carried over and the bucket goes. So a key holds one value and what the watermark
    hasn't passed, with or without left rows.
    """

    def __init__(self, bucket_ms: int):
        self.bucket_ms = bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", "value double")
        self.rights = handle.getMapState("rights", "bucket bigint", "items string")
        self.lefts = handle.getMapState("lefts", "ms bigint", "items string")

    def _add(self, state, key: int, items: list) -> None:
        held = json.loads(state.getValue((key,))[0]) if state.containsKey((key,)) else []
        state.updateValue((key,), (json.dumps(held + items),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        lefts, rights = defaultdict(list), defaultdict(list)
        for row in rows:
            if row["side"] == "right":
                rights[row["ms"] // self.bucket_ms].append((row["ms"], row["value"]))
            else:
                lefts[row["ms"]].append(row["row"])
        for bucket, items in rights.items():
            self._add(self.rights, bucket, items)
            self.handle.registerTimer((bucket + 1) * self.bucket_ms - 1)
        for ms, items in lefts.items():
            self._add(self.lefts, ms, items)
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        bucket = now // self.bucket_ms
        own = sorted(map(tuple, json.loads(self.rights.getValue((bucket,))[0]))) if self.rights.containsKey((bucket,)) else []
        past = [v for t, v in own if t <= now]
        value = past[-1] if past else self.carried.get()[0] if self.carried.exists() else None
        if self.lefts.containsKey((now,)):
            for row in json.loads(self.lefts.getValue((now,))[0]):
                yield Row(key=key[0], row=row, ms=now, value=value, ts=datetime.fromtimestamp(now / 1000, UTC))
            self.lefts.removeKey((now,))
        if own and now == (bucket + 1) * self.bucket_ms - 1:
            self.carried.update((own[-1][1],))
            self.rights.removeKey((bucket,))

    def close(self) -> None:
        pass


class AsOfHistory(StatefulProcessor):
    """Joins each left row with the latest right value at or before its time, late rows included.

    A key has a clock of its own: the largest time it has met, less delay_ms. A left row is answered once the clock has
    passed it; one that comes behind the clock, however late, at once. If there is no value at or before its time, it waits
    for a late one until the clock is wait_ms past it, and then comes out with null. With wait_clock_ms it also comes out
    so long after its arrival by the processing time, with what is known then, even if its key gets no more rows.

    Right values are held in time buckets, back to retain_ms before the clock, and of older ones the youngest. So a key
    holds what came within the horizon and what waits. Rows without a time are answered with null at once.
    """

    def __init__(self, delay_ms: int, retain_ms: int, wait_ms: int, bucket_ms: int, wait_clock_ms: int | None = None):
        self.delay_ms, self.retain_ms, self.wait_ms, self.bucket_ms, self.wait_clock_ms = delay_ms, retain_ms, wait_ms, bucket_ms, wait_clock_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.top = handle.getValueState("top", "ms bigint")
        self.older = handle.getValueState("older", "ms bigint, value double")
        self.rights = handle.getMapState("rights", "bucket bigint", "items string")
        self.lefts = handle.getMapState("lefts", "bucket bigint", "items string")

    def _value(self, ms: int, buckets: list[int], read: dict[int, list]) -> tuple[int | None, float | None]:
        """Time and value of the youngest right row at or before a time. buckets: those held, in order. A late row's bucket may
        lie behind the youngest value that has left the horizon."""
        older = tuple(self.older.get()) if self.older.exists() else None
        older = older if older and older[0] <= ms else (None, None)
        for bucket in reversed(buckets[: bisect_right(buckets, ms // self.bucket_ms)]):
            if bucket not in read:
                read[bucket] = sorted(map(tuple, json.loads(self.rights.getValue((bucket,))[0])))
            at = bisect_right(read[bucket], (ms, float("inf")))
            if at:
                found = read[bucket][at - 1]
                return found if older[0] is None else max(found, older)
        return older

    def _answered(self, key, clock: int | None, now: int | None) -> Iterator[Row]:
        """Rows that wait, as far as the clock or the processing time lets them out."""
        buckets, read = sorted(k[0] for k in self.rights.keys()), {}
        for bucket in sorted(k[0] for k in self.lefts.keys()):
            passed = clock is not None and bucket * self.bucket_ms <= clock
            if not passed and now is None:
                break
            stay, items = [], json.loads(self.lefts.getValue((bucket,))[0])
            for ms, arrived, row in items:
                over = now is not None and self.wait_clock_ms is not None and now >= arrived + self.wait_clock_ms
                if not over and (clock is None or ms > clock):
                    stay.append((ms, arrived, row))
                    continue
                at, value = self._value(ms, buckets, read)
                if at is None and not over and clock < ms + self.wait_ms:
                    stay.append((ms, arrived, row))
                    continue
                yield Row(key=key[0], row=row, ms=ms, value_ms=at, value=value)
            if len(stay) < len(items):
                self.lefts.updateValue((bucket,), (json.dumps(stay),)) if stay else self.lefts.removeKey((bucket,))

    def _add(self, state, items: dict[int, list]) -> None:
        for bucket, new in items.items():
            held = json.loads(state.getValue((bucket,))[0]) if state.containsKey((bucket,)) else []
            state.updateValue((bucket,), (json.dumps(held + new),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.wait_clock_ms is not None else None
        lefts, rights, top = defaultdict(list), defaultdict(list), self.top.get()[0] if self.top.exists() else None
        for row in rows:
            ms = row["ms"]
            if ms is None:
                if row["side"] == "left":
                    yield Row(key=key[0], row=row["row"], ms=None, value_ms=None, value=None)
                continue
            top = ms if top is None else max(top, ms)
            if row["side"] == "right":
                rights[ms // self.bucket_ms].append((ms, row["value"]))
            else:
                lefts[ms // self.bucket_ms].append((ms, now, row["row"]))
        if top is None:
            return
        self.top.update((top,))
        self._add(self.rights, rights)
        self._add(self.lefts, lefts)
        if lefts and now is not None:
            self.handle.registerTimer(now + self.wait_clock_ms)
        clock = top - self.delay_ms
        yield from self._answered(key, clock, None)
        least = (clock - self.retain_ms) // self.bucket_ms
        gone = [k[0] for k in self.rights.keys() if k[0] < least]
        if gone:
            youngest = max(tuple(x) for x in json.loads(self.rights.getValue((max(gone),))[0]))
            if not self.older.exists() or tuple(self.older.get()) < youngest:
                self.older.update(youngest)
            for bucket in gone:
                self.rights.removeKey((bucket,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        clock = self.top.get()[0] - self.delay_ms if self.top.exists() else None
        yield from self._answered(key, clock, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


class ArrivalCount(StatefulProcessor):
    """Counts a key's rows in windows of the processing time at which they arrive, whatever the micro-batch; a window's
    count comes out once the clock has passed its end. What a key holds is one window and its count."""

    def __init__(self, size_ms: int):
        self.size_ms = size_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start bigint, n bigint")

    def _row(self, key, start: int, n: int) -> Row:
        return Row(key=key[0], start_ms=start, end_ms=start + self.size_ms, n=n)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        start, n = now - now % self.size_ms, sum(1 for _ in rows)
        if self.open.exists():
            before, had = self.open.get()
            if before == start:
                n += had
            else:  # its timer hasn't fired yet
                self.handle.deleteTimer(before + self.size_ms)
                yield self._row(key, before, had)
        self.open.update((start, n))
        self.handle.registerTimer(start + self.size_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            start, n = self.open.get()
            if start + self.size_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield self._row(key, start, n)

    def close(self) -> None:
        pass


#: Types of keys whose equal values are equal bytes; keys of others are counted one by one.
COUNTED = {"tinyint", "smallint", "int", "bigint", "boolean", "date", "string", "binary"}


class ArrivalCounts(StatefulProcessor):
    """ArrivalCount for all keys of a bucket, whose rows come counted: a row is an Arrow table of keys and their counts in a
    task, and a window's counts are one such table."""

    def __init__(self, size_ms: int):
        self.size_ms = size_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start bigint, counts binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        start, parts = now - now % self.size_ms, [_unpacked(row["counts"]) for row in rows]
        if self.open.exists():
            before, had = self.open.get()
            if before == start:
                parts.append(_unpacked(had))
            else:  # its timer hasn't fired yet
                self.handle.deleteTimer(before + self.size_ms)
                yield Row(start_ms=before, counts=bytes(had))
        self.open.update((start, _packed(_summed(parts, ["key"]))))
        self.handle.registerTimer(start + self.size_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            start, had = self.open.get()
            if start + self.size_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield Row(start_ms=start, counts=bytes(had))

    def close(self) -> None:
        pass


def _packed(counts: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, counts.schema) as writer:
        writer.write_table(counts)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(packed)).read_all()


def _summed(parts: list[pa.Table], by: list[str]) -> pa.Table:
    return pa.concat_tables(parts).group_by(by).aggregate([("n", "sum")]).select([*by, "n_sum"]).rename_columns([*by, "n"])


def counted_by_bucket(rows: DataFrame) -> DataFrame:
    """__bucket and the counts of its keys in one task, of rows with the column key. Nothing waits for another micro-batch."""

    def given(counts: pa.Table) -> pa.RecordBatch:
        counts = counts.sort_by("__bucket").combine_chunks()
        runs = counts["__bucket"].combine_chunks().value_counts() if counts.num_rows else pa.array([], pa.struct([("values", pa.int32()), ("counts", pa.int64())]))
        buckets, packed, low = runs.field(0), [], 0
        for n in runs.field(1).to_pylist():
            packed.append(_packed(counts.slice(low, n).select(["key", "n"])))
            low += n
        return pa.RecordBatch.from_arrays([buckets, pa.array(packed, pa.binary())], names=["__bucket", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, fresh, held = None, [], 0
        for batch in batches:
            fresh.append(pa.Table.from_batches([batch]).append_column("n", pa.repeat(pa.scalar(1, pa.int64()), batch.num_rows)))
            held += batch.num_rows
            if held >= HELD_ROWS:
                counts = _summed([*([counts] if counts else []), *fresh], ["__bucket", "key"])
                fresh, held = [], 0
                if counts.num_rows >= HELD_ROWS:
                    yield given(counts)
                    counts = None
        if fresh:
            counts = _summed([*([counts] if counts else []), *fresh], ["__bucket", "key"])
        if counts:
            yield given(counts)

    return rows.select(F.pmod(F.hash("key"), F.lit(BUCKETS)).alias("__bucket"), "key").mapInArrow(run, "__bucket int, counts binary")


class _OneKey:
    """States and timers of the key at hand, as a processor sees them."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name: str, schema) -> _Value:
        return _Value(self, name)

    def getMapState(self, name: str, key_schema, value_schema) -> _Map:
        return _Map(self, name)

    def registerTimer(self, ms: int) -> None:
        self.timers.add(ms)

    def deleteTimer(self, ms: int) -> None:
        self.timers.discard(ms)

    def listTimers(self) -> Iterator[int]:
        return iter(sorted(self.timers))


class _Value:
    def __init__(self, host: _OneKey, name: str):
        self.host, self.name = host, name

    def exists(self) -> bool:
        return self.name in self.host.states

    def get(self) -> tuple | None:
        return self.host.states.get(self.name)

    def update(self, value: tuple) -> None:
        self.host.states[self.name] = tuple(value)

    def clear(self) -> None:
        self.host.states.pop(self.name, None)


class _Map:
    def __init__(self, host: _OneKey, name: str):
        self.host, self.name = host, name

    def _held(self) -> dict:
        return self.host.states.get(self.name, {})

    def containsKey(self, key: tuple) -> bool:
        return key in self._held()

    def getValue(self, key: tuple) -> tuple | None:
        return self._held().get(key)

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.host.states.setdefault(self.name, {})[key] = tuple(value)

    def keys(self) -> Iterator[tuple]:
        return iter(list(self._held()))

    def removeKey(self, key: tuple) -> None:
        held = self._held()
        held.pop(key, None)
        if not held:
            self.host.states.pop(self.name, None)


class ManyKeys(StatefulProcessor):
    """Runs a processor for each key of a bucket. The store holds one value a bucket, with states and timers of its keys,
    and one timer, the earliest of theirs; a key that holds nothing goes. Of time, "None" has no timers.

    A bucket's rows of one micro-batch are held at once. The first column of its rows is the bucket."""

    def __init__(self, own: StatefulProcessor, key: str, time: str):
        self.own, self.key, self.time = own, key, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.one = handle, _OneKey()
        self.store = handle.getValueState("keys", "timer bigint, held binary")
        self.own.init(self.one)

    def _read(self) -> tuple[int | None, dict]:
        """The bucket's timer; and for each key how it is known, itself, its states and timers."""
        stored = self.store.get()
        return (stored[0], pickle.loads(bytes(stored[1]))) if stored else (None, {})

    def _write(self, timer: int | None, held: dict, fired: int | None = None) -> None:
        earliest = min((t for _, _, timers in held.values() for t in timers), default=None)
        if earliest != timer:
            if timer is not None and timer != fired:  # one that has fired is deleted by the engine
                self.handle.deleteTimer(timer)
            if earliest is not None:
                self.handle.registerTimer(earliest)
        self.store.update((earliest, pickle.dumps(held, pickle.HIGHEST_PROTOCOL))) if held else self.store.clear()

    def _keep(self, held: dict, known, key) -> None:
        if self.one.states or self.one.timers:
            held[known] = (key, self.one.states, self.one.timers)
        else:
            held.pop(known, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        by_key, fields = {}, None
        for row in rows:
            if fields is None:
                fields = Row(*row.__fields__[1:])
                at = fields.index(self.key)
            row = fields(*row[1:])
            own = row[at]
            known = own if isinstance(own, int | str) else repr(own + 0.0 if isinstance(own, float) else own).encode()
            if known in by_key:
                by_key[known][1].append(row)
            else:
                by_key[known] = (own, [row])
        timer, held = self._read()
        for known, (own, its_rows) in by_key.items():
            _, self.one.states, self.one.timers = held.get(known) or (own, {}, set())
            yield from self.own.handleInputRows((own,), iter(its_rows), timerValues)
            self._keep(held, known, own)
        self._write(timer, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() if self.time == "EventTime" else timerValues.getCurrentProcessingTimeInMs()
        timer, held = self._read()
        for known, (own, self.one.states, self.one.timers) in list(held.items()):
            while due := sorted(t for t in self.one.timers if t <= now):
                for t in due:
                    if t in self.one.timers:
                        yield from self.own.handleExpiredTimer((own,), timerValues, ExpiredTimerInfo(t))
                        self.one.timers.discard(t)
            self._keep(held, known, own)
        self._write(timer, held, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        self.own.close()


def by_key(stream: DataFrame, key: str, own: StatefulProcessor, schema: StructType | str, time: str, event_time: str = "") -> DataFrame:
    """A processor's rows for each key of a stream."""
    bucketed = stream.select(F.pmod(F.hash(key), F.lit(BUCKETS)).alias("__bucket"), "*")
    return bucketed.groupBy("__bucket").transformWithState(ManyKeys(own, key, time), schema, "Append", time, eventTimeColumnName=event_time)


def dedup_stream(stream: DataFrame, key: str, time_ms: str, ts: str, ttl_ms: int, delay: str) -> DataFrame:
    """First rows of each key, with an exact TTL. time_ms is the event time in milliseconds, ts the same as a timestamp."""
    watermarked = stream.filter(F.col(time_ms).isNotNull()).withWatermark(ts, delay)
    return by_key(watermarked, key, FirstWithinTtl(time_ms, ttl_ms), stream.schema, "EventTime")


def dedup_store_stream(stream: DataFrame, key: str, time: str, ttl_ms: int) -> DataFrame:
    """First rows of each key, which the state store remembers for so long by the clock; for sources whose rows have no time to
    go by. The stream ends only when it is stopped."""
    return stream.groupBy(key).transformWithState(FirstOfStore(time, ttl_ms), stream.schema, "Append", "ProcessingTime")


def running_count_stream(stream: DataFrame, key: str, time: str) -> DataFrame:
    schema = StructType(list(stream.schema)).add("n", LongType())
    return by_key(stream, key, RunningCount(time), schema, "None")


def match_or_orphan_stream(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, timeout_ms: int, ttl_ms: int, delay: str | None) -> DataFrame:
    """key, join_kind, left_value, right_value: one row for each key of either stream. Without delay, deadlines are of
    processing time."""
    side = lambda df, name: df.filter(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_millis(ts).alias("ms"), F.lit(name).alias("side"), F.col(value).cast("string").alias("value"))
    both = side(left, "left").unionByName(side(right, "right"))
    both = both.withWatermark("ts", delay) if delay else both
    kind = left.schema[key].dataType.simpleString()
    processor = MatchOrOrphan(timeout_ms, ttl_ms, delay is None)
    return by_key(both, "key", processor, f"key {kind}, join_kind string, left_value string, right_value string", "EventTime" if delay else "ProcessingTime")


def _sides(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Left rows as JSON and right values in one stream."""
    l = left.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_millis(ts).alias("ms"), F.lit("left").alias("side"), F.to_json(F.struct("*")).alias("row"), F.lit(None).cast("double").alias("value"))  # noqa: E741
    known = right.filter(F.col(value).isNotNull() & F.col(ts).isNotNull())
    r = known.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_millis(ts).alias("ms"), F.lit("right").alias("side"), F.lit(None).cast("string").alias("row"), F.col(value).cast("double").alias("value"))
    return l.unionByName(r)


def asof_stream(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, bucket_ms: int, delay: str | None) -> DataFrame:
    """key, row (the left row as JSON), ms, value, ts: the right value as of each left row's time. bucket_ms: width of the
    time buckets in which right values are held, a part of the delay at best. Rows behind the watermark don't take part;
    asof_history_stream answers those too. Without delay both inputs have watermarks already, as what a join gives. ts is
    the result's event time, so another stateful operator can follow."""
    kind = left.schema[key].dataType.simpleString()
    both = _sides(left.filter(F.col(ts).isNotNull()), right, key, ts, value)
    both = both.withWatermark("ts", delay) if delay else both
    return by_key(both, "key", AsOf(bucket_ms), f"key {kind}, row string, ms bigint, value double, ts timestamp", "EventTime", "ts")


def asof_history_stream(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, delay_ms: int, retain_ms: int, wait_ms: int, bucket_ms: int, wait_clock_ms: int | None = None) -> DataFrame:
    """key, row (the left row as JSON), ms, value_ms, value: as asof_stream, but for every left row, late ones from what is
    retained. With wait_clock_ms the stream goes by the processing time too, and ends only when it is stopped."""
    kind = left.schema[key].dataType.simpleString()
    processor = AsOfHistory(delay_ms, retain_ms, wait_ms, bucket_ms, wait_clock_ms)
    schema = f"key {kind}, row string, ms bigint, value_ms bigint, value double"
    return by_key(_sides(left, right, key, ts, value), "key", processor, schema, "None" if wait_clock_ms is None else "ProcessingTime")


def arrival_count_stream(stream: DataFrame, key: str, size_ms: int) -> DataFrame:
    """key, start_ms, end_ms, n: rows of each key in each window of their arrival. A window that several micro-batches meet
    gives one row. The stream ends only when it is stopped."""
    kind = stream.schema[key].dataType.simpleString()
    named, schema = stream.select(F.col(key).alias("key")), f"key {kind}, start_ms bigint, end_ms bigint, n bigint"
    if kind not in COUNTED:
        return by_key(named, "key", ArrivalCount(size_ms), schema, "ProcessingTime")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, packed in zip(batch.column("start_ms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                for counts in _unpacked(packed).combine_chunks().to_batches():
                    same = lambda ms, n=counts.num_rows: pa.repeat(pa.scalar(ms, pa.int64()), n)
                    yield pa.RecordBatch.from_arrays([counts.column("key"), same(start), same(start + size_ms), counts.column("n")], names=["key", "start_ms", "end_ms", "n"])

    windows = counted_by_bucket(named).groupBy("__bucket").transformWithState(ArrivalCounts(size_ms), "start_ms bigint, counts binary", "Append", "ProcessingTime")
    return windows.mapInArrow(rows, schema)
