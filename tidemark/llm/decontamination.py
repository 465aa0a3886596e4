"""Benchmark decontamination: every training passage is a query against a BM25 index of the test items.

Test items form an inverted index whose lists hold each item's BM25 weight as a share of the item's own full score, so
one threshold serves short and long items. Items are numbered by length and grouped in blocks with a maximum weight for
each term (block-max), kept for the terms that occur in it. Passages are windows of words that overlap so far that an item lies whole in one of them. For a
batch of passages the block maxima of their distinct terms bound every item's score at once; only blocks that may reach
the threshold are entered, by WAND over their lists, and all items above the threshold come back. A hit counts if the
word trigrams of both the item's question and its answer lie in the passage to a given share.

A benchmark of any size is searched whole: it is cut into shards of bounded bytes, whose indexes are made, broadcast and
searched one after the other. Weights come from the item counts of the whole benchmark, so shards don't change results.

What counts as contamination: three fifths of the word trigrams of question and answer each, in one passage. Of items
with a twentieth of their words replaced 97 % are found, with a thirteenth 85 %, with a tenth 65 % (items of 40 words).

An item's answer is what follows a line start `Answer:` or `A:`; without one, the last third of its words.

Defined cases: null and empty texts have no hits, nor have items without words; items are told apart by item_id, and of
rows that repeat each is searched, and so are those of null ids; documents may have null or repeated ids, and go by their
own texts; an empty corpus or benchmark gives no hits; other columns don't matter.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import checkpoint, map_arrow, map_batches, row_key, texts_of, without_rows

#: Text of a shard at most, of which the index is broadcast at once; an item that is longer is a shard of its own.
SHARD_BYTES = 4_000_000
#: Text of the documents that a task searches together; a document that is longer is searched alone.
SLICE_BYTES = 400_000
#: Block maxima that are summed at once, and sums held at once (of one passage at least).
ENTRIES = 1 << 18
K1, B = 1.2, 0.75
BLOCK = 4
_TABLE = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
_ANSWER = re.compile(rb"(?im)^(?:answer|a)\s*:")


def words_of(text: bytes) -> list[bytes]:
    """A-Z count as a-z; digits, letters and all beyond ASCII make words."""
    return text.translate(_TABLE).split()


def _trigrams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Corpus:
    """What the weights of an item need to know of the whole benchmark; df may be of the shard's terms alone."""

    items: int
    words: int
    longest: int
    df: dict[bytes, int]


@dataclass
class Item:
    item_id: int | None
    text: bytes

    def parts(self) -> tuple[set[tuple[bytes, ...]], set[tuple[bytes, ...]]]:
        """Trigrams of the question and of the answer."""
        split = _ANSWER.split(self.text, maxsplit=1)
        if len(split) == 2:
            return _trigrams(words_of(split[0])), _trigrams(words_of(split[1]))
        w = words_of(self.text)
        cut = -(-2 * len(w) // 3)
        return _trigrams(w[:cut]), _trigrams(w[cut:])


class ItemIndex:
    """Inverted index of test items, lists by term in order of item number. Its size grows with the items' words."""

    def __init__(self, items: list[tuple[int | None, bytes]], threshold: float = 0.6, question_share: float = 0.6, answer_share: float = 0.6, corpus: Corpus | None = None):
        self.threshold, self.question_share, self.answer_share = threshold, question_share, answer_share
        split = sorted(((len(w), i, t, Counter(w)) for i, t in items if (w := words_of(t))), key=lambda x: (x[0], x[1] is None, x[1] or 0))
        self.items = [Item(i, t) for _, i, t, _ in split]
        if corpus is None:
            corpus = Corpus(len(split), sum(x[0] for x in split), max((x[0] for x in split), default=1), Counter(t for x in split for t in x[3]))
        self.terms = {t: k for k, t in enumerate(sorted({t for x in split for t in x[3]}))}
        d = np.array([corpus.df[t] for t in self.terms], float)
        idf = np.log(1 + (corpus.items - d + 0.5) / (d + 0.5))
        mean = corpus.words / max(1, corpus.items)
        term = np.array([self.terms[t] for x in split for t in x[3]], np.int64)
        count = np.array([c for x in split for c in x[3].values()], float)
        size = np.array([x[0] for x in split], float)
        number = np.repeat(np.arange(len(split), dtype=np.int32), [len(x[3]) for x in split])
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size[number] / mean))
        weight /= np.bincount(number, weight, minlength=len(split))[number]
        order = np.argsort(term, kind="stable")
        term, self.number, self.weight = term[order], number[order], weight[order]
        self.blocks = -(-len(split) // BLOCK)
        #: Entries: the parts of the lists in a block. Their keys (term x blocks + block), places in the lists, and maxima.
        keys = term * self.blocks + self.number // BLOCK
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        self.entry = keys[starts]
        self.at = np.r_[starts, len(keys)]
        self.block_max = np.nextafter(np.maximum.reduceat(self.weight, starts).astype(np.float32), np.float32(2)) if len(keys) else np.empty(0, np.float32)
        self.block = (self.entry % max(1, self.blocks)).astype(np.int32)
        self.first = np.searchsorted(self.entry, np.arange(len(self.terms) + 1) * self.blocks)  # entry of each term
        #: Half a window: the longest item fits into any two halves side by side that it starts in the first of.
        self.half = corpus.longest
        self._parts: dict[int, tuple[set[tuple[bytes, ...]], set[tuple[bytes, ...]]]] = {}
        self._kept = 0

    @property
    def numbers(self) -> list[np.ndarray]:
        """Item numbers of each list."""
        return np.split(self.number, self.at[self.first[1:-1]])

    @property
    def weights(self) -> list[np.ndarray]:
        """Weights of each list."""
        return np.split(self.weight, self.at[self.first[1:-1]])

    def wand(self, terms: np.ndarray, block: int) -> list[tuple[int, float]]:
        """Items of a block that score the threshold or more: lists ordered by their current item; the pivot is the
        first list at which the maxima add up to the threshold, and lists before it skip to the pivot's item."""
        wanted = terms * self.blocks + block
        entries = np.searchsorted(self.entry, wanted)
        entries = entries[self.entry[np.minimum(entries, len(self.entry) - 1)] == wanted]
        cursors = [[int(self.number[self.at[e]]), e, int(self.at[e]), int(self.at[e + 1])] for e in entries.tolist()]
        heapq.heapify(cursors)
        found, least = [], self.threshold - 1e-9
        while cursors:
            bound, pivot, order = 0.0, None, []
            while cursors:
                c = heapq.heappop(cursors)
                order.append(c)
                bound += float(self.block_max[c[1]])
                if bound >= least:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            while cursors and cursors[0][0] == pivot:
                order.append(heapq.heappop(cursors))
            if full := order[0][0] == pivot:
                score = sum(float(self.weight[c[2]]) for c in order)
                if score >= least:
                    found.append((pivot, score))
            for c in order:
                if full:
                    c[2] += 1
                elif c[0] < pivot:
                    c[2] += int(np.searchsorted(self.number[c[2] : c[3]], pivot))
                if c[2] < c[3]:
                    c[0] = int(self.number[c[2]])
                    heapq.heappush(cursors, c)
        return found

    def verified(self, number: int, passage: set[tuple[bytes, ...]]) -> bool:
        if number not in self._parts:
            if self._kept > 50_000:  # trigrams
                self._parts, self._kept = {}, 0
            self._parts[number] = self.items[number].parts()
            self._kept += sum(map(len, self._parts[number]))
        question, answer = self._parts[number]
        share = lambda part: len(part & passage) / len(part) if part else 1.0
        return share(question) >= self.question_share and share(answer) >= self.answer_share

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(text, item number, passage, score) of all verified hits."""
        if not self.items:
            return []
        get, hits = self.terms.get, []
        words = [words_of(t) for t in texts]
        ids = [np.array([get(w, -1) for w in ws], np.int64) for ws in words]
        # Distinct known terms of every passage (a half window and the next), and the sums of their block maxima.
        doc = np.repeat(np.arange(len(texts)), [len(i) for i in ids])
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        half = np.concatenate([np.arange(len(i)) // self.half for i in ids]) if ids else flat
        halves, slot = np.unique(doc * np.int64(1 << 32) + half, return_inverse=True)
        known = flat >= 0
        key, term = slot[known], flat[known]
        follows = np.r_[False, halves[1:] >> 32 == halves[:-1] >> 32]  # a half that also belongs to the passage before
        second = follows[key]
        pairs = np.unique(np.r_[key, key[second] - 1] * np.int64(len(self.terms)) + np.r_[term, term[second]])
        if not len(pairs):
            return []
        for s, block in self._promising(pairs // len(self.terms), pairs % len(self.terms), len(halves)):
            d, h = int(halves[s] >> 32), int(halves[s] & 0xFFFFFFFF)
            span = slice(h * self.half, (h + 2) * self.half)
            found = self.wand(np.unique(ids[d][span][ids[d][span] >= 0]), block)
            if found:
                passage = _trigrams(words[d][span]) | ({(w,) for w in words[d][span]} | set(zip(words[d][span], words[d][span][1:], strict=False)))
                hits += [(d, number, h, score) for number, score in found if self.verified(number, passage)]
        return hits

    def _promising(self, slot: np.ndarray, term: np.ndarray, slots: int) -> Iterator[tuple[int, int]]:
        """(slot, block) where the block maxima of a slot's terms add up to the threshold; pairs are sorted by slot."""
        size = self.first[term + 1] - self.first[term]
        pairs = np.searchsorted(slot, np.arange(slots + 1))
        before = np.r_[0, np.cumsum(size)]
        low = 0
        while low < slots:
            high = int(np.searchsorted(before[pairs], before[pairs[low]] + ENTRIES, "right")) - 1
            high = min(slots, max(low + 1, min(high, low + ENTRIES // self.blocks)))
            own = slice(pairs[low], pairs[high])
            at = np.repeat(self.first[term[own]] - (before[own] - before[own.start]), size[own]) + np.arange(before[own.stop] - before[own.start])
            sums = np.bincount(np.repeat((slot[own] - low) * self.blocks, size[own]) + self.block[at], self.block_max[at])
            for x in np.flatnonzero(sums >= self.threshold - 1e-4).tolist():
                yield low + x // self.blocks, x % self.blocks
            low = high


@dataclass
class Benchmark:
    """The shards of a benchmark (rows: shard, item_id, text) and what its weights need (dfs: shard, term, df)."""

    rows: DataFrame
    shards: list[str]
    corpus: Corpus
    dfs: DataFrame | None
    thresholds: dict[str, float] = field(default_factory=dict)

    def indexes(self) -> Iterator[ItemIndex]:
        """The index of each shard, one at a time."""
        for shard in self.shards:
            items = [(r[0], r[1].encode()) for r in self.rows.filter(F.col("shard") == shard).select("item_id", "text").collect()]
            corpus = None
            if self.dfs is not None:
                df = {bytes(r[0]): r[1] for r in self.dfs.filter(F.col("shard") == shard).select("term", "df").collect()}
                corpus = Corpus(self.corpus.items, self.corpus.words, self.corpus.longest, df)
            yield ItemIndex(items, **self.thresholds, corpus=corpus)


def _terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """shard and the distinct terms of each item."""
    found = [(s, t) for s, text in zip(batch.column("shard").to_pylist(), texts_of(batch), strict=True) for t in set(words_of(text))]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary())], names=["shard", "term"])


def build_index(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, **thresholds: float) -> Benchmark:
    """Cut a benchmark into shards in the order of its partitions, and count its words and in how many items each is."""
    items = benchmark.filter("text IS NOT NULL").select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, part = 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            shards, words = [], []
            for text in texts_of(batch):
                if held and held + len(text) > shard_bytes:
                    number, held = number + 1, 0
                held += len(text)
                shards.append(f"{part}-{number}")
                words.append(len(words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.string()), *batch.columns, pa.array(words, pa.int64())], names=["shard", *batch.schema.names, "n_words"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    cut_rows = map_batches(items.coalesce(int(1 + size // (8 * shard_bytes))), cut, f"shard string, item_id {kind}, text string, n_words bigint")
    rows = checkpoint(cut_rows.filter("n_words > 0"))
    found = rows.groupBy("shard").agg(F.count(F.lit(1)), F.sum("n_words"), F.max("n_words")).collect()
    corpus = Corpus(sum(r[1] for r in found), sum(r[2] for r in found), max((r[3] for r in found), default=1), {})
    dfs = None
    if len(found) > 1:
        own = checkpoint(map_arrow(rows.select("shard", "text"), "shard string, term binary", _terms).groupBy("shard", "term").agg(F.count(F.lit(1)).alias("n")))
        dfs = checkpoint(own.join(own.groupBy("term").agg(F.sum("n").alias("df")), "term").select("shard", "term", "df"))
    return Benchmark(rows, sorted(r[0] for r in found), corpus, dfs, thresholds)


def _search(docs: DataFrame, shared: Broadcast, schema: str, id_type: pa.DataType) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        best: dict[tuple[int, int], list] = {}
        for d, number, passage, score in own.search(texts_of(batch)):
            had = best.setdefault((d, number), [passage, 0, 0.0])
            had[0], had[1], had[2] = min(had[0], passage), had[1] + 1, max(had[2], score)
        take = pa.array([k[0] for k in best], pa.int64())
        cols = [pa.array([own.items[k[1]].item_id for k in best], id_type), pa.array([v[0] for v in best.values()], pa.int64()), pa.array([v[1] for v in best.values()], pa.int64()), pa.array([v[2] for v in best.values()], pa.float64())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), *cols], names=["doc_id", "item_id", "passage", "n_passages", "score"])

    return map_arrow(docs.select("doc_id", "text"), schema, run, SLICE_BYTES)


def contaminated(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    """doc_id, item_id, passage (its first one), n_passages, score (the highest) of every item found in a document.
    Shards of a larger benchmark are searched in turn, and an index goes before the next is made."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = benchmark.rows.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item.simpleString()}, passage bigint, n_passages bigint, score double"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in benchmark.indexes():
        shared = docs.sparkSession.sparkContext.broadcast(index)
        hits = _search(docs, shared, schema, to_arrow_type(item))
        if len(benchmark.shards) == 1:
            return hits
        found = found.unionByName(checkpoint(hits).coalesce(64))
        shared.destroy()
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows in which no test item is found."""
    keyed = docs.select(row_key().alias("doc_id"), "text")
    return without_rows(docs, contaminated(keyed, build_index(benchmark)).select("doc_id"))
