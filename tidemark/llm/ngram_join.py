"""N-gram Jaccard join: documents whose sets of word 5-grams overlap by 80 % or more, and the groups they form.

Rare-first prefix filtering: two sets that overlap enough share n-grams among the first of either in any order that
holds for all. The first order puts n-grams last that a sketch of fixed width has counted often over all documents;
a set's first fifth and sixteenth is shuffled, so how many sets share each of these n-grams is then known exactly.
Similar sets share at least a twentieth of their n-grams there, so of the shuffled n-grams only a prefix in order of
the exact counts has to meet: a set most of whose n-grams nobody shares is out. Pairs that meet pass length and
positional filters, and their whole sets are compared once, behind a suffix filter.

Equal sets are one class from the start, so copies cost nothing. To keep lists of thousands of near copies linear, each
member is first compared with the one member of its lists that it meets most often. What is connected then needs no
more comparing; every pair of a list that is still apart is compared in the last round, so no link between components
is lost. N-grams and sets are compared by 64-bit hashes.

Defined cases: null or blank text has an empty set, linked with nothing, its own component; fewer words than n form one
n-gram; null ids take part but never name a component if another id does; repeated rows are copies of each other; an
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import build_filter, checkpoint, filter_bits, map_arrow, map_batches, may_hold, release, row_key, slices, texts_of, without_rows
from tidemark.llm.graph import attach, components

#: Counters of the frequency sketch, and the slices in which they are summed: a fixed 2 MB is broadcast.
SKETCH = 1 << 21
SLICES = 64
#: A list is hot if its n-gram's counter is so high, and so many times the mean counter; its rows are dealt over tasks of
#: half as many.
HOT_ROWS, HOT_TIMES = 1024, 16
#: A list with more pairs than this for each of its members, over all lists, gets another linear round first.
PAIRS_A_ROW = 300
ROUNDS = 3
#: Members of a list that meet in one task; a longer list is cut, and each two of its parts meet in a task of their own.
CELL = 512
#: A pivot's comparisons are dealt over so many tasks, or more where there are more than so many pairs for each of them.
SALTS, PAIRS_A_SALT = 32, 10_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _WordHashes(dict):
    """64-bit hashes of words; a task remembers a bounded number."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 50_000:
            self[word] = h
        return h


def shingle_set(text: bytes, n: int = 5, hashes: _WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; A-Z count as a-z and ASCII white space parts words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map((_WordHashes() if hashes is None else hashes).__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    m = len(words) - width + 1
    out = np.full(m, width, np.uint64)
    for i in range(width):
        out += h[i : i + m] * (_MULTIPLIERS[i % 5] + np.uint64(2 * (i // 5)))
        out ^= out >> np.uint64(29)
    out *= _MULTIPLIERS[1]
    return np.unique(out ^ (out >> np.uint64(32)))


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _count(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n, sid of every row, and rows (slice, counts) of each task's part of the sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hashes = np.zeros(SKETCH, np.uint32), _WordHashes()
        id_type = None
        for batch in batches:
            id_type = batch.column("doc_id").type
            sizes, sids = [], []
            for part in slices(batch):
                sets = [shingle_set(t, n, hashes) for t in texts_of(part)]
                counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                sizes += [len(s) for s in sets]
                sids += [_set_id(s) if len(s) else 0 for s in sets]
            rows = batch.num_rows
            sid = pa.array(np.array(sids, np.uint64).view(np.int64), mask=np.array(sizes) == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), sid, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=["doc_id", "n", "sid", "slice", "counts"])
        if counts.any():
            parts = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, id_type), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "n", "sid", "slice", "counts"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n bigint, sid bigint, slice int, counts binary")


def _levels(parts: DataFrame) -> np.ndarray:
    """Frequency level of each counter, one byte each, of the summed sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(s, np.zeros(SKETCH // SLICES, np.int64)).__iadd__(np.frombuffer(zlib.decompress(c), np.uint32))
        if total:
            level = [np.minimum(255, 4 * np.log2(1 + v)).astype(np.uint8).tobytes() for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(level, pa.binary())], names=["slice", "level"])

    out = np.zeros((SLICES, SKETCH // SLICES), np.uint8)
    for s, level in map_batches(parts.repartition(SLICES // 4, "slice"), run, "slice int, level binary").collect():
        out[s] = np.frombuffer(level, np.uint8)
    return out.ravel()


def extra(n):
    """N-grams that the first prefix holds beyond the usual one, less one: so many, plus one, are shared by similar sets of n or more."""
    return n // 16


def prefix_length(n, percent: int):
    return n - (n * percent + 99) // 100 + 1 + extra(n)


def _prefixes(docs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """sh, sid, n, part, level: the first n-grams of every set, each set once a task. part is 0, or from 1 on for the rows
    of a hot list; level is the counter's, which all rows of an n-gram have in common."""
    mean = float(np.exp2(levels / 4.0).mean())
    hot = int(np.ceil(4 * np.log2(max(HOT_ROWS, HOT_TIMES * mean))))
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen, hashes = shared.value, set(), _WordHashes()
        for batch in batches:
            for part in slices(batch):
                sh, sid, size = [], [], []
                for text in texts_of(part):
                    s = shingle_set(text, n, hashes)
                    if not len(s) or (own := _set_id(s)) in seen:
                        continue
                    seen.add(own)
                    order = np.argsort((level[s & np.uint64(SKETCH - 1)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")
                    first = s[order[: prefix_length(len(s), percent)]]
                    sh.append(first)
                    sid.append(np.full(len(first), own, np.uint64))
                    size.append(np.full(len(first), len(s), np.int32))
                if sh:
                    sh, sid = np.concatenate(sh), np.concatenate(sid)
                    own = level[sh & np.uint64(SKETCH - 1)].astype(np.int64)
                    parts = np.maximum(2, np.exp2(own / 4.0) / (HOT_ROWS / 2)).astype(np.uint64)
                    dealt = np.where(own >= hot, 1 + (sid % parts).astype(np.int64), 0)
                    yield pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(sid.view(np.int64)), pa.array(np.concatenate(size)), pa.array(dealt.astype(np.int32)), pa.array(own.astype(np.int32))], names=["sh", "sid", "n", "part", "level"])

    return map_batches(docs.select("text"), run, "sh bigint, sid bigint, n int, part int, level int")


def _lists(prefixes: DataFrame, percent: int) -> DataFrame:
    """sh, sid, n, pos, own: members of lists with two sets or more, in the second prefix; pos is the place in the order of
    exact counts, own the share of n-grams in the first prefix that no other set has there.

    A hot list isn't counted in one task: its counter's level stands for its count, behind all exact ones. That is as good
    an order, for all its rows have it; and hot rows stay without a look at whether another set has them.
    """
    by_list = Window.partitionBy("sh", "part")
    count = F.when(F.col("part") == 0, F.count(F.lit(1)).over(by_list)).otherwise((1 << 40) + F.col("level"))
    shared = prefixes.select("sh", "sid", "n", "part", count.alias("g"), F.min("sid").over(by_list).alias("lo"), F.max("sid").over(by_list).alias("hi"))
    shared = shared.filter("part > 0 OR lo <> hi").select("sh", "sid", "n", "part", "g").distinct()
    by_set = Window.partitionBy("sid")
    placed = shared.withColumn("rank", F.row_number().over(by_set.orderBy("g", "sh"))).withColumn("met", F.count(F.lit(1)).over(by_set))
    length = F.expr(f"n - (n * {percent} + 99) div 100 + 1 + n div 16")
    need = F.expr(f"((n * {percent} + 99) div 100) div 16 + 1")  # of the smallest partner
    kept = placed.withColumn("pos", (length - F.col("met") + F.col("rank") - 1).cast("int")).filter(F.col("pos") <= length - need)
    again = kept.select("sh", "sid", "n", "part", "pos", ((length - F.col("met")) / F.col("n")).cast("float").alias("own"), F.min("sid").over(by_list).alias("lo"), F.max("sid").over(by_list).alias("hi"))
    return again.filter("part > 0 OR lo <> hi").select("sh", "sid", "n", "pos", "own")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Do two sorted sets overlap by so many percent of their union? Parts of the range bound the overlap first."""
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    if min(len(a), len(b)) < need or not len(a):
        return False
    cuts = b[np.linspace(0, len(b), 9).astype(int)[1:-1]]
    parts = lambda x: np.diff(np.r_[0, np.searchsorted(x, cuts), len(x)])
    if np.minimum(parts(a), parts(b)).sum() < need:
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum()) >= need


def _compare(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The checkpointed pairs (a, b) whose whole sets are similar. b's text travels to a's tasks; a hot a has many of them."""
    salt = F.pmod(F.xxhash64("b"), F.lit(max(SALTS, pairs.count() // PAIRS_A_SALT))).cast("int")
    rows = pairs.join(texts.withColumnRenamed("sid", "b"), "b").select("a", salt.alias("salt"), F.col("b"), "text")
    heads = pairs.select("a", salt.alias("salt")).distinct().join(texts.withColumnRenamed("sid", "a"), "a").select("a", "salt", F.lit(None).cast("bigint").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, hashes = None, None, _WordHashes()
        for part in (p for batch in batches for p in slices(batch)):
            found = []
            for a, b, text in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), texts_of(part), strict=True):
                if b is None:
                    head, own = a, shingle_set(text, n, hashes)
                elif head == a and similar(own, shingle_set(text, n, hashes), percent):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = heads.unionByName(rows).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return map_batches(dealt, run, "a bigint, b bigint")


def _met(left: DataFrame, right: DataFrame, one: bool) -> DataFrame:
    """Join on sh. A list of t members is cut into parts of about CELL; each part of its left side (one row if `one`) meets
    each part of its right side under a key of its own, so no task forms all pairs of a long list."""
    parts = F.expr(f"(t + {CELL - 1}) div {CELL}")
    every, own = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)), lambda c: F.pmod(F.xxhash64(c), parts)
    l = left.withColumn("row", F.lit(0).cast("bigint") if one else own("a")).withColumn("col", every).drop("t")  # noqa: E741
    r = right.withColumn("col", own("b")).withColumn("row", F.lit(0).cast("bigint") if one else every).drop("t")
    return l.join(r, ["sh", "row", "col"])


def _texts(docs: DataFrame, sids: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """sid and text of one document of each set in `sids`; only documents behind a Bloom filter of their ids, and those
    without one, are cut into n-grams. One pass in Python tests and cuts, so a task needs one worker."""
    wanted = checkpoint(sids.join(classes, "sid").select("sid", "rep"))
    shared = docs.sparkSession.sparkContext.broadcast(build_filter(wanted.select(F.xxhash64("rep").alias("__h")), filter_bits(wanted.count()), False))
    near = docs.filter("text IS NOT NULL").select("text", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("h"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = batch.column("h")
        tried = h.is_null().to_numpy(zero_copy_only=False) | may_hold(shared.value, h.fill_null(0).to_numpy())
        texts, hashes = batch.column("text").filter(pa.array(tried)), _WordHashes()
        sids = [_set_id(s) if len(s := shingle_set(t, n, hashes)) else 0 for t in texts.cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([_signed(sids), texts], names=["sid", "text"])

    found = map_arrow(near, "sid bigint, text string", run)
    return checkpoint(found.join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that similar pairs lead to."""
    counted = checkpoint(_count(docs, n))
    base = counted.filter("slice IS NULL").select("doc_id", "n", "sid")
    classes = checkpoint(base.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")))
    levels = _levels(counted.filter("slice IS NOT NULL").select("slice", "counts"))
    live = checkpoint(_lists(_prefixes(docs, n, percent, levels), percent))
    parts = 8 + live.count() // 100_000  # of the small tables that follow
    texts = _texts(docs, live.select("sid").distinct().coalesce(parts), classes, n)

    # The member with the least of its own is the most central one of a list.
    pivots = live.groupBy("sh").agg(F.min(F.struct("own", "sid"))["sid"].alias("pivot"))
    most = live.join(pivots, "sh").filter("sid <> pivot").groupBy("sid", "pivot").count().groupBy("sid").agg(F.max(F.struct("count", "pivot")).alias("m"))
    tried = checkpoint(most.select(F.col("m.pivot").alias("a"), F.col("sid").alias("b")).coalesce(parts))
    links = checkpoint(_compare(tried, texts, n, percent))
    comp = components(links, "a", "b", parts)
    for turn in range(ROUNDS):
        release(docs.sparkSession)
        named = live.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid")).coalesce(parts)
        mixed = named.groupBy("sh").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("t")).filter("x <> y").select("sh", "t").coalesce(parts)
        apart = checkpoint(named.join(mixed, "sh").coalesce(parts))
        sums = apart.groupBy("sh", "comp").count().coalesce(parts).groupBy("sh").agg(F.sum("count").alias("t"), F.sum(F.col("count") * F.col("count")).alias("s"))
        rows, pairs = sums.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum((F.col("t") * F.col("t") - F.col("s")) / 2), F.lit(0))).first()
        if not rows:
            break
        last = turn == ROUNDS - 1 or pairs <= PAIRS_A_ROW * rows
        left = apart.select("sh", "t", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
        if not last:  # one member of each list against the rest of it
            chosen = left.groupBy("sh").agg(F.min_by(F.struct("t", "a", "na", "pa", "ca"), F.xxhash64("a", F.lit(turn))).alias("m"))
            left = chosen.select("sh", "m.*")
        right = apart.select("sh", "t", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))
        # At their first common n-gram in the exact order, what may still follow in the first prefixes and after them must suffice.
        size = lambda x: f"({x} - ({x} * {percent} + 99) div 100 + 1 + {x} div 16)"
        once = f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND least({size('na')} - pa, {size('nb')} - pb) + greatest(na - {size('na')}, nb - {size('nb')}) >= ceil({percent} * (na + nb) / {100 + percent})"
        new = _met(left, right, not last).filter(F.expr(f"ca <> cb AND {'(na, a) < (nb, b)' if last else 'true'} AND {once}".replace("(na, a) < (nb, b)", "(na < nb OR (na = nb AND a < b))"))).select("a", "b").distinct()
        done = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        new = checkpoint(new.coalesce(parts).join(done, ["a", "b"], "left_anti").coalesce(parts))
        more = checkpoint(_compare(new, texts, n, percent))
        if more.limit(1).count():
            links = checkpoint(links.unionByName(more).coalesce(parts))
            comp = components(links, "a", "b", parts)
        if last:
            break
        tried = checkpoint(tried.unionByName(new).coalesce(parts))

    release(docs.sparkSession)
    joined = classes.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    joined = joined.coalesce(parts + classes.count() // 100_000)
    least = joined.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = checkpoint(joined.join(least, "comp").select("sid", "component_id", "size"))
    full = base.filter("sid IS NOT NULL")
    found = attach(full, named, "sid", "size", base.count())
    blank = base.filter("sid IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(blank)


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays, the one of the smallest doc_id (null after all others, then by the text's hash);
    all rows with an empty set stay. Rows of one id with different texts are documents of their own; rows that repeat with
    id and text are one, which stays or goes with all its rows."""
    groups = jaccard_components(docs.select(row_key().alias("doc_id"), "text"), n, percent)
    return without_rows(docs, groups.filter("doc_id <> component_id").select("doc_id"))
