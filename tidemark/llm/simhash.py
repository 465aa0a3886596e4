"""SimHash near-dedup: fingerprints of word 4-grams, linked at a few differing bits by a binary trie self-join.

Each text becomes 64 bits: the majority, bit by bit, of the XXH64 of its word n-grams, repeats included. Distinct
fingerprints form a binary trie. Its upper part is cut into subtrees of bounded size by counts of prefixes; two subtrees
meet in a task only if their prefixes differ in no more bits than allowed, so Spark deals out pairs of trie nodes. In a
task two tries are descended together: a pair of nodes carries the bits in which their prefixes differ, and is left as
soon as these exceed the budget. Leaves are runs of a few fingerprints, which are compared outright.

What is wanted are groups, so a pair of subtrees that already are one group is left as well: passes with budgets of one
and two bits come before the full one and connect dense clusters cheaply. A task gives a spanning forest of its links, at
most one row a fingerprint, and components are found over all tasks' rows.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; fewer words than n are
one n-gram; null ids take part but never name a component if another id does; repeated rows are members of their
fingerprint's group; long texts are hashed piece by piece; an empty table gives an empty result; other columns don't
matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, map_arrow, map_batches, row_key, texts_of, without_rows
from tidemark.llm.graph import attach, components

#: Bytes of a text that are cut into words at once, and n-grams whose bits are counted at once.
PIECE_BYTES, COUNTED = 1 << 20, 1 << 15
#: Subtrees are cut at a share of all fingerprints, between these sizes; beyond SUBTREES of the upper size they grow.
LEAST_SUBTREE, MOST_SUBTREE, SHARE, SUBTREES = 1 << 10, 1 << 18, 32, 2048
#: Prefix bits that are counted in one job.
STEP = 6
#: Fingerprints of a leaf, pairs of nodes that are held at once, pairs of leaves that are compared at once, links that are
#: gathered before they are merged.
LEAF, HELD, COMPARED, GATHERED = 16, 1 << 18, 2048, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, cut at white space into pieces of bounded size."""
    low = 0
    while low < len(text):
        found = _SPACE.search(text, low + PIECE_BYTES) if low + PIECE_BYTES < len(text) else None
        high = found.start() if found else len(text)
        yield text[low:high].lower().split()
        low = high


def fingerprint(text: bytes, n: int = 4) -> int:
    """The unsigned 64 bits: bit i is 1 if it is set in more than half of the n-grams' hashes."""
    counts, total, words = np.zeros(64, np.int64), 0, []

    def add(words: list[bytes], width: int) -> None:
        nonlocal total
        joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        m = len(words) - width + 1
        starts, stops = (ends - lengths)[:m].tolist(), ends[width - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        for at in range(0, m, COUNTED):
            h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + COUNTED], stops[at : at + COUNTED], strict=True)], np.uint64)
            counts.__iadd__(np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64))
        total += m

    for piece in _pieces(text):
        words += piece
        if len(words) >= n:
            add(words, n)
            words = words[len(words) - n + 1 :]
    if words and not total:
        add(words, len(words))
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed number) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, n) for t in texts_of(batch)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), f"doc_id {kind}, fp bigint", run)


# The trie of one or two subtrees, inside a task


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of unsigned numbers."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(shift)
    return (64 - np.bitwise_count(x)).astype(np.int64)


def differing(x: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Bits set among the first `depth` bits of x."""
    shift = (63 - np.minimum(depth, 63)).astype(np.uint64)
    return np.where(depth >= 64, np.bitwise_count(x), np.where(depth <= 0, 0, np.bitwise_count((x >> shift) >> np.uint64(1))))


class Trie:
    """Binary tries over sorted distinct keys, each over a range of them, chains of single children contracted.

    A node is a range of keys with `depth` common leading bits; it has two children, or is a leaf of at most LEAF keys.
    """

    def __init__(self, keys: np.ndarray, ranges: list[tuple[int, int]]):
        self.keys = keys
        lo, hi = (np.array([r[i] for r in ranges], np.int64) for i in (0, 1))
        los, his, depths, lefts, self.levels, count = [], [], [], [], [], 0
        while len(lo):
            depth = _leading(keys[lo] ^ keys[hi - 1])
            inner = hi - lo > LEAF
            self.levels.append((count, count + len(lo)))
            left = np.full(len(lo), -1, np.int64)
            left[inner] = count + len(lo) + 2 * np.arange(inner.sum())
            los.append(lo), his.append(hi), depths.append(depth), lefts.append(left)
            count += len(lo)
            bit = (63 - depth[inner]).astype(np.uint64)
            cut = np.searchsorted(keys, (keys[hi[inner] - 1] >> bit) << bit)
            lo, hi = np.stack([lo[inner], cut], 1).ravel(), np.stack([cut, hi[inner]], 1).ravel()
        self.lo, self.hi, self.depth, self.left = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (los, his, depths, lefts))
        self.first = keys[self.lo]
        self.label = np.arange(len(keys))
        self.whole = np.full(count, -1, np.int64)

    def _members(self, nodes: np.ndarray) -> np.ndarray:
        """Places of the keys of leaves, the last one repeated up to LEAF."""
        lo, hi = self.lo[nodes], self.hi[nodes]
        return np.minimum(lo[:, None] + np.arange(LEAF), hi[:, None] - 1)

    def _merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Take links into the labels: a label is the smallest place of a group."""
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]

    def _name(self) -> None:
        """`whole`: the group of all keys of a node, -1 if they are of several."""
        for start, end in reversed(self.levels):
            nodes = np.arange(start, end)
            leaf = self.left[nodes] < 0
            own = self.label[self._members(nodes[leaf])]
            self.whole[nodes[leaf]] = np.where((own == own[:, :1]).all(axis=1), own[:, 0], -1)
            l, r = self.whole[self.left[nodes[~leaf]]], self.whole[self.left[nodes[~leaf]] + 1]  # noqa: E741
            self.whole[nodes[~leaf]] = np.where(l == r, l, -1)

    def _leaves(self, a: np.ndarray, b: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(a), COMPARED):
            x, y = self._members(a[at : at + COMPARED]), self._members(b[at : at + COMPARED])
            near = np.bitwise_count(self.keys[x][:, :, None] ^ self.keys[y][:, None, :]) <= budget
            pair, i, j = np.nonzero(near)
            i, j = x[pair, i], y[pair, j]
            apart = self.label[i] != self.label[j]
            yield i[apart], j[apart]

    def join(self, start: tuple[int, int], budget: int) -> None:
        """Link all keys below the two start nodes (one node: among themselves) that differ in at most `budget` bits."""
        stack, gathered, held = [(np.array([start[0]]), np.array([start[1]]))], [], 0
        while stack:
            a, b = stack.pop()
            if len(a) > HELD:
                stack.append((a[HELD:], b[HELD:]))
                a, b = a[:HELD], b[:HELD]
            leaf = (self.left[a] < 0) & (self.left[b] < 0)
            for i, j in self._leaves(a[leaf], b[leaf], budget):
                gathered.append((i, j))
                held += len(i)
                if held > GATHERED:
                    self._merge(*(np.concatenate(x) for x in zip(*gathered, strict=True)))
                    gathered, held = [], 0
            a, b = a[~leaf], b[~leaf]
            if not len(a):
                continue
            same = a == b
            l = self.left[a[same]]  # noqa: E741
            one, two = a[~same], b[~same]
            first = (self.left[one] >= 0) & ((self.left[two] < 0) | (self.depth[one] <= self.depth[two]))
            one, two = np.where(first, one, two), np.where(first, two, one)  # `one` is opened
            c, d = np.concatenate([l, l, l + 1, self.left[one], self.left[one] + 1]), np.concatenate([l, l + 1, l + 1, two, two])
            errors = differing(self.first[c] ^ self.first[d], np.minimum(self.depth[c], self.depth[d]))
            go = (errors <= budget) & ((self.whole[c] < 0) | (self.whole[c] != self.whole[d]))
            if go.any():
                stack.append((c[go], d[go]))
        if held:
            self._merge(*(np.concatenate(x) for x in zip(*gathered, strict=True)))


def forest(a: np.ndarray, b: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups of two subtrees' keys (unsigned, distinct), or of one subtree's, by links of at most
    `budget` differing bits between the two (inside the one)."""
    parts = [np.sort(x) for x in ([a] if b is None else [a, b])]
    if not all(len(p) for p in parts):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    if b is not None and parts[0][0] > parts[1][0]:
        parts.reverse()
    keys = np.concatenate(parts)
    cuts = np.cumsum([0, *map(len, parts)]).tolist()
    trie = Trie(keys, list(zip(cuts[:-1], cuts[1:], strict=True)))
    for bits in sorted({min(1, budget), min(2, budget), budget}):
        trie.join((0, len(parts) - 1), bits)
        if bits < budget:
            trie._name()
    met = np.flatnonzero(trie.label != np.arange(len(keys)))
    return keys[met], keys[trie.label[met]]


# The trie's upper part, and its pairs of subtrees dealt out by Spark


def subtrees(keys: DataFrame, total: int, most: int) -> list[tuple[int, int]]:
    """(prefix, depth) of the subtrees of at most `most` keys into which a trie of `total` keys is cut, by counts of
    prefixes. Only prefixes that hold more than `most` keys are counted further, so a job gives 2^STEP counts for each
    of total / most of them at most."""
    done: list[tuple[int, int]] = []
    heavy, depth = [0], 0

    def cut(prefix: int, at: int, to: int, counts: dict[int, int]) -> None:
        n = sum(counts.values())
        if not n:
            return
        if n <= most or at == 64:
            done.append((prefix, at))
        elif at == to:
            heavy.append(prefix)
        else:
            middle = (2 * prefix + 1) << (to - at - 1)
            cut(2 * prefix, at + 1, to, {k: v for k, v in counts.items() if k < middle})
            cut(2 * prefix + 1, at + 1, to, {k: v for k, v in counts.items() if k >= middle})

    if total <= most:
        return [(0, 0)] if total else []
    while heavy:
        to = min(64, depth + STEP)
        rows = keys if not depth else keys.filter(F.shiftrightunsigned("fp", 64 - depth).isin(heavy))
        met = rows.groupBy((F.shiftrightunsigned("fp", 64 - to) if to < 64 else F.col("fp")).alias("p")).count().collect()
        own: dict[int, dict[int, int]] = {p: {} for p in heavy}
        for p, n in met:
            own[(p % (1 << to)) >> (to - depth)][p % (1 << to)] = n
        heavy, before = [], depth
        depth = to
        for prefix, counts in own.items():
            cut(prefix, before, to, counts)
    return sorted(done, key=lambda x: x[0] << (64 - x[1]))


def node_pairs(nodes: list[tuple[int, int]], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i <= j) of subtrees whose prefixes differ in at most `budget` bits as far as both go."""
    low = np.array([p << (64 - d) for p, d in nodes], np.uint64)
    depth = np.array([d for _, d in nodes], np.int64)
    found = [(i, i + np.flatnonzero(differing(low[i:] ^ low[i], np.minimum(depth[i:], depth[i])) <= budget)) for i in range(len(nodes))]
    return np.concatenate([np.full(len(j), i) for i, j in found]), np.concatenate([j for _, j in found])


def linked(keys: DataFrame, total: int, bits: int) -> DataFrame:
    """a, b: links that span the groups of distinct fingerprints (column fp) at most `bits` bits apart."""
    most = max(LEAST_SUBTREE, min(MOST_SUBTREE, total // SHARE), total // SUBTREES)
    nodes = subtrees(keys, total, most)
    if not nodes:
        return keys.sparkSession.createDataFrame([], "a bigint, b bigint")
    one, two = node_pairs(nodes, bits)
    number = np.arange(len(one))
    cross = one != two
    at, pair, second = np.concatenate([one, two[cross]]), np.concatenate([number, number[cross]]), np.concatenate([np.zeros(len(one), bool), np.ones(cross.sum(), bool)])
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(nodes) + 1))
    low = np.array([p << (64 - d) for p, d in nodes], np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast((low, starts, pair[order].astype(np.int32), second[order]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, starts, pair, second = shared.value
        rows = max(1, (1 << 20) // max(1, int(np.diff(starts).max())))
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False)
            for k in range(0, len(every), rows):
                fp = every[k : k + rows]
                node = np.searchsorted(low, fp.view(np.uint64), "right") - 1
                n = starts[node + 1] - starts[node]
                place = np.repeat(starts[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(pair[place]), pa.array(second[place]), pa.array(np.repeat(fp, n))], names=["pair", "second", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None

        def joined() -> Iterator[pa.RecordBatch]:
            fp, side = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = forest(fp[~side], fp[side] if cross[own] else None, bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            pairs, side, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.r_[np.flatnonzero(np.diff(pairs, prepend=pairs[0] - 1)), len(pairs)] if len(pairs) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if own is not None and pairs[x] != own:
                    yield from joined()
                    held = []
                own = pairs[x]
                held.append((fp[x:y].view(np.uint64), side[x:y].astype(bool)))
        if held:
            yield from joined()

    dealt = map_batches(keys.select("fp"), deal, "pair int, second boolean, fp bigint")
    tasks = int(min(len(one), 16 + total // 20_000))
    return map_batches(dealt.repartition(tasks, "pair").sortWithinPartitions("pair"), meet, "a bigint, b bigint")


def simhash_components(docs: DataFrame, n: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row: the smallest doc_id that links of at most `bits`
    differing bits lead to."""
    own = checkpoint(fingerprints(docs, n))
    groups = checkpoint(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")))
    total = groups.count()
    links = checkpoint(linked(groups.select("fp"), total, bits))
    comp = components(links, "a", "b", int(8 + total // 100_000))
    named = groups.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    found = attach(own, checkpoint(named.join(least, "comp").select("fp", "component_id", "size")), "fp", "size", own.count())
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_simhash_copies(docs: DataFrame, n: int = 4, bits: int = 4) -> DataFrame:
    """One document of each group stays, the one of the smallest doc_id (null after all others, then by the text's hash),
    with all its columns; rows that repeat with id and text are one, which stays or goes with all its rows."""
    keyed = docs.select(row_key().alias("doc_id"), "text")
    return without_rows(docs, simhash_components(keyed, n, bits).filter("doc_id <> component_id").select("doc_id"))
