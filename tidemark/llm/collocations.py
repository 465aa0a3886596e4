"""Phrase collocations: phrases that occur often, scored by how much more often than their parts would meet by chance.

Frequent n-grams are found by mergeable Misra-Gries summaries. N-grams fall into hash partitions, and these into cells. A
first pass counts how many occurrences (mass) each cell has. A cell of less than the threshold needs no capacity: nothing
in it is frequent. The mass of a partition's other cells tells how large its summary must be: its capacity exceeds
mass / threshold. A task sums up its own texts; over capacity, a summary takes its largest count that must go off all counts and remembers it as its error.
Summaries of one partition are merged in one task by the same rule. What is taken off in all is less than the threshold,
so each n-gram of the threshold or more survives, with count and error still reaching it. A last pass counts survivors
exactly: a Bloom filter picks their places, and words themselves, not hashes, are counted. A task's counts travel packed
by hash partition.

One and two words are summed up first; longer n-grams count only where all shorter ones inside them survived, which a
frequent n-gram's do. The pass that sums up short ones counts the cells of longer ones, too. Masses travel as gaps between
the cells that a task met. Filters and capacities are broadcast: a filter, and the bits of all cells, have 64 MB each at
most and capacities 10 MB; a fuller filter, or fuller cells, let more n-grams through and change no result.

A phrase's parts are frequent too, so all counts that scores need are among the frequent ones. Scores are made in whole
decimal numbers of 38 digits. A phrase that is inside a longer candidate as often is inside one that is a word longer as
often, so dropping looks one word further only.

Defined cases: null and empty texts have no words; a null lang is `und`; a lang without a candidate gives no rows; ids
don't matter, so rows that repeat count as often as they are there; long texts are cut as they are; ties in rank are
ordered by count and phrase; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_BYTES, build_filter, checkpoint, filter_bits, map_batches, may_hold, slices, texts_of

#: Characters of text for each hash partition, and the least and the largest number of partitions.
PARTITION_CHARS, LEAST_PARTITIONS, MOST_PARTITIONS = 1 << 22, 16, 1 << 18
#: Cells for each character of text, times the threshold: a cell's mean mass is some fifteenth of it. Cells that are added
#: up together, cells at most, and cells that a task holds before it gives their masses.
CELLS, SLICE_CELLS, MOST_CELLS, CELLS_HELD = 5, 1 << 16, 1 << 29, 1 << 22
#: Words that a task remembers, and n-grams that it gathers, before it goes on without them.
WORDS, GATHERED = 500_000, 1 << 21
#: Bytes that are hashed at once.
BLOCK = 1 << 18
#: Phrases that a task counts, and words that it meets, before it gives their counts.
COUNTED, MET = 200_000, 1 << 31
#: Partitions of the exact count at most, so that a task's rows don't grow with the corpus.
MOST_COUNTED = 512
#: A-Z as a-z, all ends of pieces as one, tabs as spaces.
_TABLE = bytes(c + 32 if 65 <= c < 91 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


#: By length of n-grams: a Bloom filter of their hashes (False) or the bits of their cells (True).
Among = dict[int, tuple[np.ndarray, bool]]


class Lexicon(dict):
    """Numbers of words, in the order in which a task meets them."""

    def __init__(self) -> None:
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


@dataclass
class Words:
    """The words of some texts: hash, lang's number, how many words follow in the piece, itself included, and, with a
    lexicon, number."""

    langs: list[str]
    hashes: np.ndarray
    lang: np.ndarray
    left: np.ndarray
    lexicon: Lexicon | None
    ids: np.ndarray | None

    def ngrams(self, longest: int, among: Among) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length up to `longest`: where such an n-gram begins, and its hash with its lang. It, and all inside it,
        pass what `among` has for their length."""
        seeds = np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in self.langs), np.uint64, len(self.langs))
        h = self.hashes
        at, state, before = np.arange(len(h)), seeds[self.lang], None
        for length in range(1, longest + 1):
            if length > 1:  # an n-gram goes on where the one that starts a word later is there, too
                go = self.left[at] >= length
                go &= before[np.minimum(at + 1, len(h) - 1)]
                at, state = at[go], state[go]
            state = ((state ^ (state >> np.uint64(29))) * _MULTIPLIER) + h[at + length - 1]
            mixed = (state ^ (state >> np.uint64(32))) * _MULTIPLIER
            mixed ^= mixed >> np.uint64(29)
            if length in among and len(at):
                bits, cells = among[length]
                kept = in_cells(bits, mixed) if cells else may_hold(bits, mixed.view(np.int64))
                at, state, mixed = at[kept], state[kept], mixed[kept]
            yield at, mixed
            before = np.zeros(len(h), bool)
            before[at] = True


class _Powers:
    """Fixed random numbers for bytes, and the powers of an odd number and its inverse (all modulo 2^64) for a block."""

    def __init__(self) -> None:
        base = 0x9E3779B97F4A7C15
        self.of_byte = np.random.default_rng(13).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(BLOCK, x % 2**64, np.uint64)]) for x in (base, pow(base, -1, 2**64)))


_powers = cache(_Powers)


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of a translated text, which ends with a dot, begins; how many dots are before it; its hash.

    A word's hash is a polynomial of its bytes, so prefix sums give those of all words at once. Sums go on from block to
    block, so words of any length take no more memory than others."""
    powers, found = _powers(), []
    total, dots, inside = np.uint64(0), 0, False
    up = down = np.uint64(1)
    for low in range(0, len(text), BLOCK):
        block = np.frombuffer(text, np.uint8, min(BLOCK, len(text) - low), low)
        dot = block == 46
        flips = np.flatnonzero(np.diff(~(dot | (block == 32)), prepend=inside))  # beginnings and ends by turns
        sums = np.r_[np.uint64(0), np.cumsum(powers.of_byte[block] * powers.up[: len(block)])] * up + total
        found.append((flips + low, sums[flips], powers.down[flips] * down, np.cumsum(dot)[flips] + dots))
        inside ^= bool(len(flips) % 2)
        total, dots = sums[-1], dots + int(dot.sum())
        up, down = np.multiply(up, powers.up[BLOCK]), np.multiply(down, powers.down[BLOCK])
    at, sums, scale, before = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), *[np.empty(0, np.uint64)] * 2, np.empty(0, np.int64))
    h = (sums[1::2] - sums[::2]) * scale[::2]
    return at[::2], before[::2], (h ^ (h >> np.uint64(31))) * _MULTIPLIER


def words_of(texts: list[bytes], langs: list[str], lexicon: Lexicon | None = None) -> Words:
    """Words and their hashes; with a lexicon, their numbers, too."""
    names: dict[str, int] = {}
    owner = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
    texts = [t.translate(_TABLE) + b"." for t in texts]
    at, piece, h = hashed(b"".join(texts))
    ends = np.flatnonzero(np.r_[piece[1:] != piece[:-1], True]) if len(piece) else piece
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(piece)) + 1
    lang = owner[np.searchsorted(np.cumsum([len(t) for t in texts]), at, "right")]
    ids = None if lexicon is None else np.concatenate([np.empty(0, np.int64), *(_numbers(t, lexicon) for t in texts)])
    return Words(list(names), h, lang, left, lexicon, ids)


def _numbers(text: bytes, lexicon: Lexicon) -> np.ndarray:
    """Long texts are cut between words, so a few words are held as objects at once."""
    text, low, numbers = text.replace(b".", b" "), 0, []
    while low < len(text):
        cut = text.find(b" ", low + SLICE_BYTES) + 1 or len(text)
        words = text[low:cut].split()
        numbers.append(np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words)))
        low = cut
    return np.concatenate(numbers)


def _all_words(batches: Iterator[pa.RecordBatch], numbered: bool = False) -> Iterator[Words]:
    lexicon = Lexicon() if numbered else None
    for batch in batches:
        for part in slices(batch):
            if numbered and len(lexicon.words) > WORDS:
                lexicon = Lexicon()
            yield words_of(texts_of(part), part.column("lang").to_pylist(), lexicon)


def partition_of(h: np.ndarray, partitions: int) -> np.ndarray:
    """The first bits of a hash, so sorted hashes are sorted by partition."""
    return (h >> np.uint64(64 - (partitions.bit_length() - 1))).astype(np.int64)


def in_cells(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes are in cells whose bit is set."""
    cell = partition_of(h, len(bits) * 8)
    return ((bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed: all their lowest bytes, then the next ones."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Masses:
    """Occurrences by cell, of the cells that were met, in order."""

    def __init__(self, cells: int):
        self.total = cells
        self.clear()

    def clear(self) -> None:
        self.cells, self.counts, self.fresh, self.waiting = np.empty(0, np.uint32), np.empty(0, np.int64), [], 0

    def add(self, h: np.ndarray) -> None:
        self.fresh.append(partition_of(h, self.total).astype(np.uint32))
        self.waiting += len(h)
        if self.waiting > max(GATHERED, len(self.cells)):
            self.fold()

    def fold(self) -> None:
        fresh, n = np.unique(np.concatenate([np.empty(0, np.uint32), *self.fresh]), return_counts=True)
        every = np.concatenate([self.cells, fresh])
        order = np.argsort(every, kind="stable")
        every, n = every[order], np.concatenate([self.counts, n])[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
        self.cells, self.counts = every[first], np.add.reduceat(n, first) if len(first) else n
        self.fresh, self.waiting = [], 0

    def rows(self) -> Iterator[list]:
        """slice, gaps between its cells, their counts; afterwards nothing is held."""
        self.fold()
        own = self.cells // SLICE_CELLS
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else own
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            yield [int(own[low]), _packed(np.diff(self.cells[low:high] % SLICE_CELLS, prepend=np.uint32(0))), _packed(self.counts[low:high])]
        self.clear()


def frequent_cells(masses: DataFrame, threshold: int, cells: int, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the cells that have `threshold` occurrences or more, and how many those of each partition have."""
    width = max(1, partitions * SLICE_CELLS // cells)  # partitions of a slice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, gaps, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = total.setdefault(s, np.zeros(SLICE_CELLS, np.int64))
                own[np.cumsum(_unpacked(gaps), dtype=np.int64)] += _unpacked(counts)
        for s, own in total.items():
            own[own < threshold] = 0
            row = [[s], [zlib.compress(np.packbits(own > 0).tobytes(), 1)], [own.reshape(width, -1).sum(axis=1).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "bits", "mass"])

    bits, mass = np.zeros(cells // 8, np.uint8), np.zeros(cells // SLICE_CELLS * width, np.int64)
    parts = masses.select("part", "keys", "counts").repartition(min(cells // SLICE_CELLS, 64), "part")
    for s, own, counts in map_batches(parts, run, "part int, bits binary, mass binary").collect():
        bits[s * SLICE_CELLS // 8 : (s + 1) * SLICE_CELLS // 8] = np.frombuffer(zlib.decompress(own), np.uint8)
        mass[s * width : (s + 1) * width] = np.frombuffer(counts, np.int64)
    return bits, mass.reshape(partitions, -1).sum(axis=1)


class Summary:
    """Misra-Gries counts of hashes (sorted) in partitions from `low` on, each with a capacity, and what was taken off."""

    def __init__(self, capacity: np.ndarray, partitions: int, low: int = 0):
        self.capacity, self.partitions, self.low = capacity, partitions, low
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.error = np.zeros(len(capacity), np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Take in sorted distinct keys."""
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        every, n = every[order], np.concatenate([self.counts, counts])[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
        self.keys, self.counts = every[first], np.add.reduceat(n, first) if len(first) else n
        own = partition_of(self.keys, self.partitions) - self.low
        cuts = np.searchsorted(own, np.arange(len(self.capacity) + 1))
        over = np.flatnonzero(np.diff(cuts) > self.capacity)
        for p in over:
            part = self.counts[cuts[p] : cuts[p + 1]]
            off = np.partition(part, len(part) - self.capacity[p] - 1)[len(part) - self.capacity[p] - 1]
            part -= off  # at least capacity + 1 counts were as large
            self.error[p] += off
        if len(over):
            kept = self.counts > 0
            self.keys, self.counts = self.keys[kept], self.counts[kept]


def scanned(docs: DataFrame, among: Among, short: range, capacity: np.ndarray, long: range, cells: int) -> DataFrame:
    """part, keys, counts, error: each task's summaries of the n-grams of lengths `short`; and, where the error is null, masses
    of the cells of those of lengths `long` (slice, gaps, counts)."""
    partitions, names = len(capacity), ["part", "keys", "counts", "error"]
    shared = docs.sparkSession.sparkContext.broadcast((capacity, among))

    def batch(rows: list[list]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        capacity, among = shared.value
        own, fresh, held, met = Summary(capacity, partitions), [], 0, Masses(cells)
        for words in _all_words(batches):
            for k, (_, h) in enumerate(words.ngrams(max([*short, *long]), among)):
                if k + 1 in short:
                    fresh.append(h)
                    held += len(h)
                elif k + 1 in long:
                    met.add(h)
            if held > max(GATHERED, len(own.keys)):  # so each n-gram is sorted a few times at most
                own.add(*np.unique(np.concatenate(fresh), return_counts=True))
                fresh, held = [], 0
            if len(met.cells) > CELLS_HELD and (rows := [[*r, None] for r in met.rows()]):
                yield batch(rows)
        if rows := [[*r, None] for r in met.rows()]:
            yield batch(rows)
        if held:
            own.add(*np.unique(np.concatenate(fresh), return_counts=True))
        cuts = np.searchsorted(partition_of(own.keys, partitions), np.arange(partitions + 1))
        for p in np.flatnonzero((np.diff(cuts) > 0) | (own.error > 0)):
            cut = slice(cuts[p], cuts[p + 1])
            yield batch([[int(p), own.keys[cut].tobytes(), zlib.compress(own.counts[cut].tobytes(), 1), int(own.error[p])]])

    return checkpoint(map_batches(docs, run, "part int, keys binary, counts binary, error bigint"))


def survivors(parts: DataFrame, threshold: int, capacity: np.ndarray) -> DataFrame:
    """h: hashes that may occur `threshold` times or more by their tasks' summaries; all that do are there."""
    partitions = len(capacity)
    shared = parts.sparkSession.sparkContext.broadcast(capacity)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Summary | None = None
        for batch in batches:
            for part, keys, counts, error in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if own is None or own.low != part:
                    if own is not None:
                        yield _reaching(own, threshold)
                    own = Summary(shared.value[part : part + 1], partitions, part)
                own.add(np.frombuffer(keys, np.uint64), np.frombuffer(zlib.decompress(counts), np.int64))
                own.error[0] += error
        if own is not None:
            yield _reaching(own, threshold)

    return map_batches(parts.repartition(min(partitions, 2048), "part").sortWithinPartitions("part"), merge, "h bigint")


def _reaching(own: Summary, threshold: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(own.keys[own.counts + own.error[0] >= threshold].view(np.int64))], names=["h"])


def counted(docs: DataFrame, longest: int, among: np.ndarray, partitions: int) -> DataFrame:
    """part, lang, phrases, counts, from each task: the places of n-grams that the filter holds. A row has all phrases of a lang
    whose hash falls into one partition, in order and packed, so rows go with tasks and partitions, not with phrases; null
    phrases have all words of the lang."""
    shared = docs.sparkSession.sparkContext.broadcast(among)

    def packed(found: dict[tuple[str, bytes | None], int]) -> pa.RecordBatch:
        rows: dict[tuple[int, str, bool], list[bytes | None]] = {}
        for lang, phrase in found:
            part = 0 if phrase is None else zlib.crc32(phrase) % partitions
            rows.setdefault((part, lang, phrase is None), []).append(phrase)
        cols = [[k[0] for k in rows], [k[1] for k in rows], [], []]
        for (_, lang, every), phrases in rows.items():
            if not every:
                phrases.sort()
            cols[2].append(None if every else zlib.compress(b"\n".join(phrases), 1))  # a line's end is in no phrase
            cols[3].append(_packed(np.array([found[lang, x] for x in phrases])))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["part", "lang", "phrases", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bytes | None], int] = {}
        met = 0
        for words in _all_words(batches, True):
            met += len(words.lang)
            for k, n in zip(*np.unique(words.lang, return_counts=True), strict=True):
                key = (words.langs[k], None)
                found[key] = found.get(key, 0) + int(n)
            for k, (at, h) in enumerate(words.ngrams(longest, dict.fromkeys(range(1, longest + 1), (shared.value, False)))):
                for lang, phrase, n in _exact(words, at, h, k + 1):
                    found[lang, phrase] = found.get((lang, phrase), 0) + n
            if len(found) > COUNTED or met > MET:
                yield packed(found)
                found, met = {}, 0
        if found:
            yield packed(found)

    return map_batches(docs, run, "part int, lang string, phrases binary, counts binary")


def summed(parts: DataFrame, threshold: int, partitions: int) -> DataFrame:
    """lang, phrase, n of the phrases that all tasks together have `threshold` times or more; a null phrase has all words of the
    lang. A partition's phrases meet in one task, as words."""

    def rows(found: dict[tuple[str, bytes | None], int]) -> pa.RecordBatch:
        kept = [(lang, phrase, n) for (lang, phrase), n in found.items() if phrase is None or n >= threshold]
        cols = list(zip(*kept, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()).cast(pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bytes | None], int] = {}
        own = None
        for batch in batches:
            for part, lang, phrases, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != own and found:
                    yield rows(found)
                    found = {}
                own = part
                for phrase, n in zip([None] if phrases is None else zlib.decompress(phrases).split(b"\n"), _unpacked(counts).tolist(), strict=True):
                    found[lang, phrase] = found.get((lang, phrase), 0) + n
        if found:
            yield rows(found)

    return map_batches(parts.repartition(partitions, "part").sortWithinPartitions("part"), run, "lang string, phrase string, n bigint")


def _exact(words: Words, at: np.ndarray, h: np.ndarray, length: int) -> Iterator[tuple[str, bytes, int]]:
    """lang, phrase and count of the n-grams at these places; n-grams of one hash are one phrase only if their words are."""
    if not len(at):
        return
    _, first, own, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    head = at[first][own]
    same = words.lang[at] == words.lang[head]
    for j in range(length):
        same &= words.ids[at + j] == words.ids[head + j]
    n = n - np.bincount(own[~same], minlength=len(n))
    rows = words.ids[at[first][:, None] + np.arange(length)].tolist()
    names = words.lexicon.words
    for row, lang, k in zip(rows, words.lang[at[first]].tolist(), n.tolist(), strict=True):
        yield words.langs[lang], b" ".join([names[i] for i in row]), k
    for i in at[~same].tolist():
        yield words.langs[words.lang[i]], b" ".join([names[w] for w in words.ids[i : i + length]]), 1


def frequent_phrases(docs: DataFrame, threshold: int = 100, longest: int = 5) -> DataFrame:
    """lang, phrase, n of all phrases of up to `longest` words with n >= threshold; a null phrase has all words of a lang."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text IS NOT NULL")
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    partitions = 1 << (max(LEAST_PARTITIONS, min(MOST_PARTITIONS, chars // PARTITION_CHARS)).bit_length() - 1)
    cells = max(SLICE_CELLS, partitions, min(MOST_CELLS, 1 << (CELLS * chars // threshold).bit_length()))
    none, short, long = np.zeros(partitions, np.int64), range(1, min(2, longest) + 1), range(3, longest + 1)
    bloom = lambda h: build_filter(h, filter_bits(h.count()), False)

    def among(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        bits, mass = frequent_cells(parts.filter("error IS NULL"), threshold, cells, partitions)
        return bits, mass // threshold + 1

    bits, capacity = among(scanned(texts, {}, range(0), none, short, cells))
    parts = scanned(texts, dict.fromkeys(short, (bits, True)), short, capacity, long, cells)
    every = met = checkpoint(survivors(parts.filter("error IS NOT NULL"), threshold, capacity))
    if long:
        bits, capacity = among(parts)
        longer = scanned(texts, dict.fromkeys(short, (bloom(met), False)) | dict.fromkeys(long, (bits, True)), long, capacity, range(0), cells)
        every = checkpoint(met.unionByName(survivors(longer, threshold, capacity)))
    parts = min(partitions, MOST_COUNTED)
    return summed(counted(texts, longest, bloom(every), parts), threshold, parts)


def collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, percent: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first `top` phrases of two words or more, without those that a
    longer one holds `percent` per cent as often."""
    found = checkpoint(frequent_phrases(docs, threshold, longest))
    totals = found.filter("phrase IS NULL").select("lang", "n")
    known = found.filter("phrase IS NOT NULL").select("lang", "phrase", F.col("n").alias("a"))
    words = known.withColumn("w", F.split("phrase", " ")).filter("size(w) > 1")
    inside = words.filter("size(w) > 2").select("lang", "a", F.explode(F.expr("array(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1))")).alias("w"))
    inside = inside.groupBy("lang", F.concat_ws(" ", "w").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = words.join(inside, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {percent} * a").drop("longer")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("concat_ws(' ', slice(w, 1, k))").alias("first"), F.expr("concat_ws(' ', slice(w, k + 1, size(w)))").alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 * a AS decimal(19, 0)) * cast(n AS decimal(18, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(18, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    best = best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("place", rank).filter(F.col("place") <= top)
    return ranked.select("lang", F.col("place").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
