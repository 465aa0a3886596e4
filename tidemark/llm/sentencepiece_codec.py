"""SentencePiece encoding and decoding of merge-type models.

Encoding keeps, for every prefix of a word, the one token that ends the prefix's encoding. Whether a vocabulary entry
that ends there may follow the token stored for the shorter prefix is decided by a pair-compatibility test: the two
stand side by side in an encoding exactly if merging their joined text gives the two again. Candidates come from an
automaton over the vocabulary; ids are recovered from the last prefix backwards.

No piece of such a model holds the space mark after another character, so merges never cross the start of a word and a
text falls into independent words, each encoded once and remembered. Space marks before a word form runs that merge
from the left. Characters outside the vocabulary become byte pieces.

Defined cases: a null or empty text has no ids and decodes to an empty text; other columns don't matter; repeated rows
give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import weakref
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches, slices

SPACE = "▁"
#: Words of a column remembered by a task: when as many new ones have come, those not met since are forgotten.
MEMORY = 50_000
#: Bytes up to which such a word is remembered.
LONG = 64
#: Parts of words that a task remembers, twice, in the same way.
PARTS = 25_000
#: Pairs of pieces whose test a worker remembers.
PAIRS = 150_000
#: Characters up to which a word is coded whole: looking for seams costs more than the table of a few more prefixes.
SHORT = 24
#: Text that is coded at once.
SLICE_BYTES = 1_000_000


class PieceModel:
    """The tables of a model file: pieces, ranks, byte pieces, and how every piece splits."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a merge-type model without text normalisation is needed")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.unknown = self.kinds.index(2)
        self.unk_surface = proto.trainer_spec.unk_surface
        self.bytes_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        if any(p.type in (4, 5) for p in proto.pieces) or any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type == 1):
            raise ValueError("user-defined pieces and pieces across words aren't supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        #: A higher score merges first; equal scores occur only among runs of space marks.
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.run = max((len(p) for p in self.ids if not p.strip(SPACE)), default=1)
        self._split: dict[str, tuple[str, str] | None] = {}
        self.tested = 0
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1 and piece.strip(SPACE) and self.reachable(piece):  # a single character is what remains
                self.automaton.add_word(piece, (piece, len(piece), _Follows(self, piece)))
        self.automaton.make_automaton()
        #: Ids as they are joined.
        self.written = {p: str(i) for p, i in self.ids.items()}
        #: Neighbouring characters inside pieces; no merge crosses any other seam.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: ASCII marks that stand beside none but marks and spaces in pieces: a text is cut around their runs.
        marks = {chr(c) for c in range(128) if not chr(c).isalnum()}
        while alone := {c for a, b in self.inside for c, d in ((a, b), (b, a)) if c in marks and d not in marks and d != SPACE}:
            marks -= alone
        runs = f"[{re.escape(''.join(sorted(marks)))}]+" if marks else f"(?!){SPACE}"
        self.words = re.compile(f"{SPACE}*(?:{runs}|[^{SPACE}{re.escape(''.join(sorted(marks)))}]+)|{SPACE}+")
        #: What a piece decodes to; None for byte pieces, which join to characters first.
        self.surfaces = [self.unk_surface if k == 2 else "" if k == 3 else None if k == 6 else p.replace(SPACE, " ") for p, k in zip(self.pieces, self.kinds, strict=True)]

    def merged(self, text: str) -> list[str]:
        """Reference merging of a short text, the best pair first and the leftmost of equals: used for vocabulary splits only."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one; None for single characters and pieces that merging never makes."""
        if piece not in self._split:
            own = self.score.pop(piece)
            parts = self.merged(piece)
            self.score[piece] = own
            self._split[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._split[piece]

    def reachable(self, piece: str) -> bool:
        return len(piece) == 1 or self.split(piece) is not None

    def fits(self, left: str, right: str) -> bool:
        """May the two follow each other? No merge across the seam may come before the merges that built both sides."""
        limit, seam_first, a, b, fit = float("-inf"), False, left, right, True
        while True:
            joined = self.score.get(a + b)
            # While a and b stood here, the seam merges before the merge undone last if it scores higher, or as high and further left.
            if joined is not None and (joined > limit or (joined == limit and seam_first)):
                fit = False
                break
            undo_a, undo_b = self.split(a) if len(a) > 1 else None, self.split(b) if len(b) > 1 else None
            if undo_a is None and undo_b is None:
                break
            # The later of the two last merges is undone: the one of the lower score, or of equal ones the right one.
            if undo_b is None or (undo_a is not None and self.score[a] < self.score[b]):
                limit, seam_first, a = self.score[a], False, undo_a[1]
            else:
                limit, seam_first, b = self.score[b], True, undo_b[0]
        return fit

    def word(self, text: str) -> list[int]:
        """Ids of one word: space marks, then other characters."""
        out, ids = [], self.ids
        for piece in self.pieces_of(text):
            if (i := ids.get(piece)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in piece.encode()) if self.byte_ids else out.append(self.unknown)
        return out

    def pieces_of(self, text: str) -> list[str]:
        """Pieces of one word, and characters that are none."""
        if text[0] != SPACE:
            return self._table(text)
        bare = text.lstrip(SPACE)
        marks, last = len(text) - len(bare), []
        if bare:
            last, marks = self._table(SPACE + bare), marks - 1
            if last[0] == SPACE:  # the mark stays apart and joins the run before it
                last, marks = last[1:], marks + 1
        runs, rest = divmod(marks, self.run)
        return [SPACE * self.run] * runs + [SPACE * rest] * (rest > 0) + last

    def _table(self, text: str) -> list[str]:
        """Pieces of a text: the last piece of every prefix, longest candidate first, followed backwards from the end."""
        last, settled = list(text), -1
        for end, (piece, length, follows) in self.automaton.iter(text):  # at each end from the longest to the shortest
            if end != settled and (end < length or follows[last[end - length]]):
                last[end], settled = piece, end
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(piece := last[at])
            at -= len(piece)
        out.reverse()
        return out

    def seams(self, text: str) -> list[str]:
        """The text cut where no merge crosses."""
        whole = list(map(self.inside.__contains__, map(add, text, text[1:])))
        if all(whole):
            return [text]
        cuts = [0, *(i for i, one in enumerate(whole, 1) if not one), len(text)]
        return [text[a:b] for a, b in pairwise(cuts)]


class _Follows(dict):
    """By the piece before: may this piece follow it? What isn't known yet is tested; all of a model's pieces remember PAIRS
    answers together. The model is held weakly: Python's garbage collector doesn't see into the automaton, so a model
    that its own automaton led back to would never be freed."""

    __slots__ = ("model", "piece")

    def __init__(self, model: PieceModel, piece: str):
        self.model, self.piece = weakref.ref(model), piece

    def __missing__(self, left: str) -> bool:
        model = self.model()
        if model.tested >= PAIRS:
            for _, _, follows in model.automaton.values():
                follows.clear()
            model.tested = 0
        model.tested += 1
        self[left] = fit = model.fits(left, self.piece)
        return fit


class Codec:
    """Encoder and decoder with a bounded memory of words: a word's ids joined by commas, and what they decode to (with the
    leading space still there) only where that isn't the word itself. Words of columns are held as Arrow arrays, which take a
    sixth of the room of Python's strings and are looked up all at once; a dictionary holds the parts that words share."""

    def __init__(self, model: bytes):
        self.model = PieceModel(model)
        self.forget()

    def forget(self) -> None:
        """Drop what was remembered of the texts."""
        self.memory: dict[str, str | tuple[str, str]] = {}
        self.older: dict[str, str | tuple[str, str]] = {}
        self.known = tuple(pa.array([], pa.string()) for _ in range(3))
        self.met, self.fresh = np.empty(0, bool), 0

    def _entry(self, word: str) -> str | tuple[str, str]:
        """Ids of a word, with their text where it isn't the word."""
        if (known := self.older.get(word)) is None:
            parts = [word] if len(word) <= SHORT else self.model.seams(word)
            if len(parts) > 1:
                get, older = self.memory.get, self.older.get
                known = self.join(parts, [get(p) or older(p) or self._coded(p) for p in parts])
                if len(parts) > 2:  # as good as never seen again
                    return known
            else:
                return self._coded(word)
        return self._keep(word, known)

    def _coded(self, word: str) -> str | tuple[str, str]:
        """The same of a word without seams that isn't remembered."""
        model = self.model
        try:  # pieces alone are the word itself
            known = ",".join([model.written[p] for p in model.pieces_of(word)])
        except KeyError:
            ids = model.word(word)
            known, surface = ",".join(map(str, ids)), self.surface(ids)
            if surface != word.replace(SPACE, " "):
                known = known, surface
        return self._keep(word, known)

    def _keep(self, word: str, known: str | tuple[str, str]) -> str | tuple[str, str]:
        if len(self.memory) >= PARTS:
            self.memory, self.older = {}, self.memory
        self.memory[word] = known
        return known

    def entry(self, text: str, prefix: str | None = None) -> str | tuple[str, str]:
        """Ids of a text, with what they decode to where that isn't the text behind its prefix."""
        if not text:
            return ""
        text = (self.model.prefix if prefix is None else prefix) + text.replace(" ", SPACE)
        words = [text] if text.lstrip(SPACE).isalnum() else self.model.words.findall(text)
        if len(words) == 1:
            return self.memory.get(words[0]) or self._entry(words[0])
        make, out = self._entry, []
        for at in range(0, len(words), 5000):
            get = self.memory.get  # the memory changes hands when it is full
            out += [get(w) or make(w) for w in words[at : at + 5000]]
        return self.join(words, out)

    @staticmethod
    def join(words: list[str], found: list[str | tuple[str, str]]) -> str | tuple[str, str]:
        if not any(type(f) is tuple for f in found):
            return ",".join(found)
        pairs = [f if type(f) is tuple else (f, w.replace(SPACE, " ")) for w, f in zip(words, found, strict=True)]
        return ",".join([p[0] for p in pairs]), "".join([p[1] for p in pairs])

    def encode(self, text: str) -> list[int]:
        found = self.entry(text)
        return [int(i) for i in (found if type(found) is str else found[0]).split(",") if i]

    def surface(self, ids: list[int]) -> str:
        """Text of ids; byte pieces join to characters, and bytes that don't form one become replacement characters."""
        m, out, run = self.model, [], bytearray()
        try:
            return "".join([m.surfaces[i] for i in ids])
        except TypeError:  # there are byte pieces
            pass

        def flush() -> None:
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                del run[:n]

        for i in ids:
            if i in m.bytes_of:
                run.append(m.bytes_of[i])
                continue
            flush()
            out.append(m.surfaces[i])
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self._strip(self.surface(ids))

    def _strip(self, surface: str) -> str:
        return surface[1:] if self.model.prefix and surface.startswith(" ") else surface

    def _words(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids, and what they decode to, of distinct words, each with a space before it."""
        at = pc.index_in(words, value_set=self.known[0])
        unknown = at.is_null().to_numpy(zero_copy_only=False)
        at, new = at.fill_null(0).to_numpy().astype(np.int64), words.filter(pa.array(unknown))
        memory, older = self.memory, self.older
        found = [memory.get(w) or older.get(w) or self.entry(w, "") for w in [SPACE + t for t in new.to_pylist()]]
        at[unknown] = len(self.known[0]) + np.arange(len(found))
        new = new, pa.array([f if type(f) is str else f[0] for f in found], pa.string()), pa.array([None if type(f) is str else f[1] for f in found], pa.string())
        _, ids, surfaces = (pa.concat_arrays([a, b]).take(pa.array(at)) for a, b in zip(self.known, new, strict=True))
        self._remember(at[~unknown], new)
        return ids, pc.coalesce(surfaces, pc.binary_join_element_wise("", words, " "))

    def _remember(self, met: np.ndarray, new: tuple[pa.Array, ...]) -> None:
        self.met[met] = True
        short = pc.less_equal(pc.binary_length(new[0]), LONG)
        self.known = tuple(pa.concat_arrays([a, b.filter(short)]) for a, b in zip(self.known, new, strict=True))
        added = len(self.known[0]) - len(self.met)
        self.met, self.fresh = np.r_[self.met, np.ones(added, bool)], self.fresh + added
        if self.fresh >= MEMORY:
            stay = pa.array(np.flatnonzero(self.met)[-2 * MEMORY :])
            self.known = tuple(a.take(stay) for a in self.known)
            self.met, self.fresh = np.zeros(len(stay), bool), 0

    def columns(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Numbers of ids, ids joined by commas, and decoded texts of a column.

        Texts are split at single spaces and words coded once for the column; the words' results are put together by
        Arrow. Texts with runs of spaces, or space marks of their own, go one by one.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, f"^( |$)|  |{SPACE}") if self.model.prefix else pa.array([True] * len(texts), pa.bool_())
        plain = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        words = plain.values.dictionary_encode()
        own_ids, own_surfaces = self._words(words.dictionary)
        together = lambda values, sep: pc.binary_join(pa.ListArray.from_arrays(plain.offsets, values.take(words.indices)), sep)
        ids = together(own_ids, ",")
        decoded = pc.utf8_slice_codeunits(together(own_surfaces, ""), 1)  # without the first space
        if pc.any(odd).as_py():
            rest = texts.filter(odd).to_pylist()
            found = [self.entry(t) for t in rest]
            ids = pc.replace_with_mask(ids, odd, pa.array([f if type(f) is str else f[0] for f in found], pa.string()))
            surfaces = [(self.model.prefix.replace(SPACE, " ") + t).replace(SPACE, " ") if type(f) is str and t else f[1] if f else "" for t, f in zip(rest, found, strict=True)]
            decoded = pc.replace_with_mask(decoded, odd, pa.array([self._strip(t) for t in surfaces], pa.string()))
        counts = pc.if_else(pc.equal(ids, ""), 0, pc.add(pc.count_substring(ids, ","), 1)).cast(pa.int64())
        return counts, ids, decoded


_codecs: dict[int, Codec] = {}


def _worker_codec(model: bytes) -> Codec:
    """The one codec of a worker. Tasks must get it by this function, which they find by name: a global that a task's own
    code names travels with the task, so each would start from an empty dictionary and build the tables anew."""
    key = zlib.crc32(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def _coded(docs: DataFrame, model_path: str, keep: list[str], schema: str, to_columns: Callable[[pa.Array, pa.Array], list[pa.Array]], names: list[str]) -> DataFrame:
    """mapInArrow over slices: kept columns, numbers of ids, and what to_columns makes of ids and decoded texts. The model's
    bytes are broadcast; a worker builds its tables once, and a task forgets its words at its end."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker_codec(shared.value)
        for part in (p for b in batches for p in slices(b, SLICE_BYTES)):
            counts, ids, decoded = codec.columns(part.column("text"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), counts, *to_columns(ids, decoded)], names=[*keep, "n_tokens", *names])
            pa.default_memory_pool().release_unused()
        codec.forget()

    return map_batches(docs.select(*keep, *(["text"] if "text" not in keep else [])), run, schema)


def encode_documents(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_tokens, ids (array<int>) and decoded (the ids' text) of every row; the whole texts stay in their tasks."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens bigint, ids array<int>, decoded string"])

    def lists(ids: pa.Array, decoded: pa.Array) -> list[pa.Array]:
        return [pc.if_else(pc.equal(ids, ""), pa.scalar([], pa.list_(pa.string())), pc.split_pattern(ids, ",")).cast(pa.list_(pa.int32())), decoded]

    return _coded(docs, model_path, list(keep), schema, lists, ["ids", "decoded"])


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, from the same columns as encode_documents()."""

    def digests(*columns: pa.Array) -> list[pa.Array]:
        return [pa.array([hashlib.sha256(t).hexdigest() for t in c.cast(pa.binary()).to_pylist()], pa.string()) for c in columns]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _coded(docs, model_path, ["doc_id"], f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", digests, ["ids_sha256", "decoded_sha256"])
