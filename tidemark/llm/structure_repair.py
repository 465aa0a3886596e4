"""Conversation structure repair by a dynamic program over grammar-compressed sequences.

A row is a symbol: the initial of its role and its first fault. The sequences of symbols that a task holds are compressed
together by Re-Pair: the most frequent pair of neighbours becomes a rule, until no pair repeats. Each rule has one
min-plus transfer matrix between the states of the wanted pattern `(s?(ua)+)?`: the least cost from state to state, and
the edits that reach it as a rope, whose halves are those of its two parts. Matrices are made bottom-up, once a rule, and
so shared by all conversations in which the rule occurs. Ties go to the edits that are ASCII-least; ropes are compared by
length and hash from the left, so no rope is written out before the end.

Rows are dealt out by ranges of conversation and turn, so a conversation of any length lies in many tasks: a piece of one
gives its matrix, and the pieces of a conversation are multiplied in order. Texts travel once, in the order of the edits,
for the repaired text's hash, which is built row by row; what a task holds of a conversation is its edits, a byte a row.

Edits: Keep costs 0; Rerole to user or assistant 2; Delete 3, required for blank and duplicate rows; Insert an empty user
or assistant row 2; each truncated row that stays costs 1 more.

Defined cases: null roles and texts are one space; a null conv_id is one conversation; null turns come first; rows that
tie on a turn are ordered by role, the beginning of the text and its hash; rows that repeat are duplicates; a role without
an initial of s, u or a can't be kept; a conversation without rows has zeros and no audit; an empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, map_batches, slices
from tidemark.llm.graph import attach

#: Symbols that are compressed together at once, and first characters of a text that order rows of one turn.
COMPRESSED, ORDERED = 1 << 18, 64
#: Rows of a range of conversations and turns, which is one task's.
RANGE_ROWS = 200_000
#: Bytes of results that are given at once.
GIVEN = 1_000_000
INITIALS, FAULTS = "sua?", ("", "blank", "duplicate", "truncated")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a. Where each role, and an insertion, leads.
STATES = 4
_ROLE = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "?": {}}
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_BASE, _PRIME = 911382323, (1 << 61) - 1


class Rope:
    """A text as a tree, with its length and hash."""

    __slots__ = ("size", "hash", "power", "leaf", "parts")

    def __init__(self, leaf: str = "", parts: tuple[Rope, Rope] | None = None):
        self.leaf, self.parts = leaf, parts
        if parts:
            a, b = parts
            self.size, self.power = a.size + b.size, a.power * b.power % _PRIME
            self.hash = (a.hash * b.power + b.hash) % _PRIME
        else:
            self.size, self.power, self.hash = len(leaf), pow(_BASE, len(leaf), _PRIME), 0
            for c in leaf:
                self.hash = (self.hash * _BASE + ord(c)) % _PRIME

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            r = stack.pop()
            if r.parts:
                stack += (r.parts[1], r.parts[0])
            else:
                out.append(r.leaf)
        return "".join(out)


def before(a: Rope, b: Rope) -> bool:
    """Is a's text less than b's? Equal parts are skipped by their hash."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p.size == q.size and p.hash == q.hash:
            continue
        if p.parts and (p.size >= q.size or not q.parts):
            x += (p.parts[1], p.parts[0])
            y.append(q)
        elif q.parts:
            y += (q.parts[1], q.parts[0])
            x.append(p)
        else:
            k = min(p.size, q.size)
            if p.leaf[:k] != q.leaf[:k]:
                return p.leaf < q.leaf
            if p.size > k:
                x.append(Rope(p.leaf[k:]))
            if q.size > k:
                y.append(Rope(q.leaf[k:]))
    return bool(y) and any(r.size for r in y) and not any(r.size for r in x)


#: From state to state: (cost, rope), or nothing where no edits lead there.
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def _better(matrix: dict, key, cost: int, rope: Rope) -> None:
    had = matrix.get(key)
    if had is None or cost < had[0] or (cost == had[0] and before(rope, had[1])):
        matrix[key] = (cost, rope)


def terminal(symbol: int) -> Matrix:
    """One row: insertions before it, then its edit. Edits end with a row's, so no edits are the beginning of others."""
    initial, fault = INITIALS[symbol // len(FAULTS)], FAULTS[symbol % len(FAULTS)]
    out: Matrix = {}
    for start in range(STATES):
        state, inserted = start, ""
        for _ in range(STATES):
            cost = INSERT * len(inserted)
            _better(out, (start, state), cost + DELETE, Rope(inserted + "D"))
            if fault not in ("blank", "duplicate"):
                cost += TRUNCATED * (fault == "truncated")
                if state in _ROLE[initial]:
                    _better(out, (start, _ROLE[initial][state]), cost + KEEP, Rope(inserted + "K"))
                _better(out, (start, _NEXT[state]), cost + REROLE, Rope(inserted + "R"))
            state, inserted = _NEXT[state], inserted + "I"
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    """Edits of a, then those of b."""
    ways, onward = defaultdict(list), defaultdict(list)
    for (k, j), way in b.items():
        onward[k].append((j, way))
    for (i, k), (cost, rope) in a.items():
        for j, (more, rest) in onward[k]:
            ways[i, j].append((cost + more, rope, rest))
    out: Matrix = {}
    for key, found in ways.items():
        least = min(w[0] for w in found)
        for _, rope, rest in (w for w in found if w[0] == least):
            _better(out, key, least, Rope(parts=(rope, rest)))
    return out


def finish(row: dict[int, tuple[int, Rope]]) -> tuple[int, str]:
    """Cost and audit of the least way from states to the pattern's end, by insertions if need be."""
    out: dict = {}
    for state, (cost, rope) in row.items():
        need = {0: "", 3: "", 2: "I", 1: "II"}[state]
        _better(out, 0, cost + INSERT * len(need), Rope(parts=(rope, Rope(need))))
    return out[0][0], str(out[0][1])


def re_pair(sequences: list[list[int]], symbols: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (pairs; the k-th one is symbol symbols + k) and the sequences in them. The pair that occurs most often is
    replaced first, the smaller one of equals, until none occurs twice in places that don't overlap."""
    seq: list[int] = []
    for s in sequences:
        seq += s
        seq.append(-1)
    n = len(seq)
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in range(n - 1):
        if seq[i] >= 0 and seq[i + 1] >= 0:
            places[seq[i], seq[i + 1]].add(i)
    heap = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        own = places.get(pair, ())
        if len(own) < 2:
            continue
        if len(own) != -count:
            heapq.heappush(heap, (-len(own), pair))
            continue
        todo, taken = [], -1
        for i in sorted(own):  # of places that overlap, the first
            if i != taken:
                todo.append(i)
                taken = after[i] if pair[0] == pair[1] else -1
        if len(todo) < 2:
            own.clear()
            continue
        new, touched = symbols + len(rules), set()
        rules.append(pair)
        del places[pair]
        for i in todo:
            j = after[i]
            k, h = after[j], prior[i]
            if h >= 0 and seq[h] >= 0:
                places[seq[h], seq[i]].discard(h)
            if k < n and seq[k] >= 0:
                places[seq[j], seq[k]].discard(j)
            seq[i], seq[j], after[i] = new, -2, k
            if k < n:
                prior[k] = i
            if h >= 0 and seq[h] >= 0:
                places[seq[h], new].add(h)
                touched.add((seq[h], new))
            if k < n and seq[k] >= 0:
                places[new, seq[k]].add(i)
                touched.add((new, seq[k]))
        places.pop(pair, None)
        for p in sorted(touched):
            if len(places[p]) > 1:
                heapq.heappush(heap, (-len(places[p]), p))
    out: list[list[int]] = [[]]
    i = 0
    while i < n:
        if seq[i] == -1:
            out.append([])
        else:
            out[-1].append(seq[i])
        i = after[i]
    return rules, out[:-1]


class Evaluator:
    """Matrices of terminals, which a task keeps, and of rules, which last for a batch of sequences."""

    def __init__(self) -> None:
        self.terminals = [terminal(k) for k in range(len(INITIALS) * len(FAULTS))]

    def matrices(self, sequences: list[bytes]) -> dict[bytes, Matrix]:
        """The matrix of each distinct sequence of symbols (none is empty)."""
        distinct = sorted(set(sequences))
        rules, compressed = re_pair([list(s) for s in distinct], len(self.terminals))
        known = list(self.terminals)
        for a, b in rules:
            known.append(product(known[a], known[b]))
        out = {}
        for name, symbols in zip(distinct, compressed, strict=True):
            while len(symbols) > 1:  # in halves, so ropes stay flat
                pairs = [symbols[i : i + 2] for i in range(0, len(symbols), 2)]
                for p in pairs:
                    if len(p) > 1:
                        known.append(product(known[p[0]], known[p[1]]))
                        p[:] = [len(known) - 1]
                symbols = [p[0] for p in pairs]
            out[name] = known[symbols[0]]
        return out


# Rows


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(`conv_id:turn`) % 20 names: 0 drops a row, 1 empties its text,
    2 takes out its [.!?], 3 repeats it, 4 makes its role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.expr("if(kind = 3, array(0, 1), array(0))"))).drop("kind", "copy")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with what orders them within a turn: the beginning of the text and two hashes of conversation, role and text."""
    return rows.withColumns({"begin": F.substring("text", 1, ORDERED), "h": F.xxhash64("conv_id", "role", "text"), "h2": F.xxhash64(F.lit(1), "conv_id", "role", "text")})


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, begin, h, h2, initial, fault, first (the turn at which the row's role and text are first met,
    where that isn't its own alone). No text travels; hot pairs of role and text are met by broadcast."""
    visible = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(F.length(visible) == 0, 1).when(F.substring(visible, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    narrow = checkpoint(_placed(rows).select("conv_id", "turn", "role", "begin", F.struct("h", "h2").alias("key"), initial.alias("initial"), fault.alias("fault")))
    when = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    groups = narrow.filter("fault <> 1").groupBy("key").agg(F.min(when).alias("first"), F.max(when).alias("last"), F.count(F.lit(1)).alias("size")).filter("first <> last")
    return attach(narrow, checkpoint(groups.select("key", "first", "size")), "key", "size", narrow.count())


_PIECE = "conv_id {0}, part bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head int, tail int, starts array<int>, ends array<int>, costs array<bigint>, audits array<string>"


def _pieces(rows: DataFrame) -> DataFrame:
    """A row for each conversation in a range of rows: counts, and the matrix of its symbols, whose rows are starts, ends,
    costs and audits. A conversation that begins and ends in the range needs the row of state 0 only."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluator, part = Evaluator(), TaskContext.get().partitionId() << 32
        held, size, own, last, id_type = [], 0, None, None, None

        def give() -> pa.RecordBatch:
            """Rows of the pieces held; only the first and the last one may go on in another batch or task."""
            nonlocal part
            matrices = evaluator.matrices([bytes(p[-1]) for p in held])
            cols: list[list] = [[] for _ in kinds]
            for k, p in enumerate(held):
                inner = 0 < k < len(held) - 1
                ways = [(i, j, cost, str(rope)) for (i, j), (cost, rope) in sorted(matrices[bytes(p[-1])].items()) if i == 0 or not inner]
                for c, v in zip(cols, [p[0], part + k, *p[1:-1], *([w[x] for w in ways] for x in range(4))], strict=True):
                    c.append(v)
            part += len(held)
            return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _PIECE.split(", ")])

        for batch in batches:
            id_type = batch.column("conv_id").type
            for conv, turn, key, initial, fault, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "key", "initial", "fault", "first")), strict=True):
                if size > COMPRESSED:
                    yield give()
                    held, size, own = [], 0, None
                if own is None or conv != own[0]:
                    own = [conv, None, None, 0, 0, 0, 0, 0, initial, initial, bytearray()]
                    held.append(own)
                if turn is not None and turn != own[2]:
                    own[1] = turn if own[1] is None else own[1]
                    own[2] = turn
                    own[3] += 1
                if fault != 1 and (last == (conv, turn, key) or (first is not None and first["turn"] != turn)):
                    fault = 2
                last = (conv, turn, key)
                if fault:
                    own[3 + fault] += 1
                if own[-1] and not legal(own[9], initial):
                    own[7] += 1
                own[9] = initial
                own[-1].append(initial * len(FAULTS) + fault)
                size += 1
        if held:
            yield give()

    kinds = [None, *[pa.int64()] * 8, pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]
    return map_batches(rows, run, _PIECE.format(kind))


def _batch(rows: list[list], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    """Rows of an id, six numbers and texts."""
    kinds = [id_type, *[pa.int64()] * len(_COUNTS), *[pa.string()] * (len(names) - 1 - len(_COUNTS))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def legal(a: int, b: int) -> bool:
    return INITIALS[a] + INITIALS[b] in ("su", "ua", "au")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _whole(pieces: DataFrame) -> DataFrame:
    """conv_id, counts, cost and audit of each conversation, whose pieces are multiplied in order."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ways, ready, id_type = None, {}, [], None

        def done() -> list:
            low, high, turns = own[1:4]
            return [own[0], 0 if low is None else high - low + 1 - turns, *own[4:8], *finish(ways)]

        for batch in batches:
            id_type = batch.column("conv_id").type
            for row in batch.to_pylist():
                conv, low, high, turns, blank, duplicate, truncated, illegal, head, tail = (row[c] for c in ("conv_id", "low", "high", "turns", *_COUNTS[1:5], "head", "tail"))
                if own is None or conv != own[0]:
                    if own is not None:
                        ready.append(done())
                    own, ways = [conv, None, None, 0, 0, 0, 0, 0, None], {0: (0, Rope())}
                if low is not None:
                    own[1] = low if own[1] is None else own[1]
                    own[3] += turns - (own[2] == low)
                    own[2] = high
                for k, v in zip(range(4, 8), (blank, duplicate, truncated, illegal), strict=True):
                    own[k] += v
                own[7] += own[8] is not None and not legal(own[8], head)
                own[8] = tail
                new: dict = {}
                for i, j, cost, audit in zip(row["starts"], row["ends"], row["costs"], row["audits"], strict=True):
                    if i in ways:
                        _better(new, j, ways[i][0] + cost, Rope(parts=(ways[i][1], Rope(audit))))
                ways = new
            if ready:
                yield _batch(ready, id_type, ["conv_id", *_COUNTS, "audit"])
                ready = []
        if own is not None:
            yield _batch([*ready, done()], id_type, ["conv_id", *_COUNTS, "audit"])

    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return map_batches(rows, run, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string")


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows."""
    found = _faults(rows)
    ranges = int(1 + found.count() // RANGE_ROWS)
    order = ["conv_id", "turn", "role", "begin"]
    dealt = found.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "key")
    return _whole(_pieces(dealt.select("conv_id", "turn", "key", "initial", "fault", "first")))


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """role and text of the rows that the edits leave of these, in order."""
    state, edits = 0, iter(audit)
    for edit in edits:
        if edit == "D":
            next(rows)
            continue
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "K":
            role = "user" if _NEXT[state] == 2 else "assistant"
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        yield role, text


def repair(turns: DataFrame, damage: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of `turns`,
    whose rows are damaged first if asked for. The hash is of `role:text` of the repaired rows, joined by newlines."""
    rows = damaged(turns) if damage else turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    found = audits(rows)
    names = turns.select("conv_id").distinct()
    plain = {"turn": turns.schema["turn"].dataType.simpleString(), "role": "string", "text": "string", "begin": "string", "key": "struct<h:bigint,h2:bigint>"}
    empty = lambda cols: [F.lit(None).cast(t).alias(c) for c, t in cols.items()]
    counts = {c: "bigint" for c in _COUNTS} | {"audit": "string"}
    heads = names.select("conv_id", F.lit(0).alias("step"), *empty(plain), *empty(counts))
    own = found.select("conv_id", F.lit(1).alias("step"), *empty(plain), *counts)
    told = _placed(rows).select("conv_id", F.lit(2).alias("step"), "turn", "role", "text", "begin", F.struct("h", "h2").alias("key"), *empty(counts))
    every = heads.unionByName(own).unionByName(told).repartition("conv_id").sortWithinPartitions("conv_id", "step", "turn", "role", "begin", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, held, id_type = [], 0, None
        for conv, id_type, numbers, digest in _hashed(batches):
            ready.append([conv, *numbers, digest])
            held += 100 + len(numbers[-1])
            if held > GIVEN:
                yield _batch(ready, id_type, ["conv_id", *counts, "repaired_sha256"])
                ready, held = [], 0
        if ready:
            yield _batch(ready, id_type, ["conv_id", *counts, "repaired_sha256"])

    return map_batches(every.select("conv_id", "step", "role", "text", *counts), run, f"conv_id {kind}, {', '.join(f'{c} {t}' for c, t in counts.items())}, repaired_sha256 string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversation, its id's type, numbers and audit, and the hash of its repaired rows, which pass one by one."""

    def told() -> Iterator[tuple]:
        for batch in (part for whole in batches for part in slices(whole)):
            kind = batch.column("conv_id").type
            numbers = [batch.column(c) for c in (*_COUNTS, "audit")]
            for k, (conv, step, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "step", "role", "text")), strict=True)):
                yield conv, step, role, text, kind, numbers, k

    rows = told()
    row = next(rows, None)
    while row is not None:
        conv, _, _, _, kind, _, _ = row
        numbers: list = [0] * len(_COUNTS) + [""]
        row = next(rows, None)
        if row is not None and row[1] == 1:
            numbers = [c[row[6]].as_py() for c in row[5]]
            row = next(rows, None)

        def texts() -> Iterator[tuple[str, str]]:
            nonlocal row
            while row is not None and row[1] == 2:
                now, row = row, next(rows, None)
                yield now[2], now[3]

        digest, first, source = hashlib.sha256(), True, texts()
        for role, text in repaired_rows(numbers[-1], source):
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
        yield conv, kind, numbers, digest.hexdigest()
