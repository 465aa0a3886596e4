"""Chat formatting by columnar byte assembly.

A turn becomes `<s>[INST]role[/INST]text</s>`. Control strings inside roles and texts get a backslash behind their first
character, and such escaped strings one more, so texts are read back exactly. Rows are sorted by conversation and turn
inside their partitions; for each batch the lengths of headers and contents give cumulative offsets, numpy scatter
indices put both into one preallocated buffer, and that buffer becomes an Arrow column without a copy. The loss mask is
the byte span of each assistant text.

Defined cases: a null text or role counts as empty; turns that tie are ordered by role and text; rows that repeat are
turns that repeat; a null conv_id is one conversation; an empty table gives an empty result; other columns don't matter.
A conversation is one row, or several pieces in order where it is longer than PIECE_BYTES, cut between turns; so a task
holds a piece, whatever a conversation's length. Digests pass over the pieces one after the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, slices

#: Control strings of the template and of its family, without their first character.
CONTROL = r"/?s>|/?INST\]|<SYS>>|</SYS>>"
#: Bytes that scatter indices are made for at once (eight bytes each), text that is assembled at once, and what a cell can hold.
INDEXED, SLICE_BYTES, MOST_BYTES = 1 << 20, 4_000_000, (1 << 31) - 1
#: Bytes of roles and texts of one conversation that are gathered before they are written as a piece.
PIECE_BYTES = 32_000_000
_ESCAPE = r"([<\[])(\\*)(" + CONTROL + ")"
_UNESCAPE = re.compile(rb"([<\[])\\(\\*)(" + CONTROL.encode() + rb")")
_HEAD, _AFTER_ROLE, _FOOT = b"<s>[INST]", b"[/INST]", b"</s>"
_TURN = re.compile(rb"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escape(values: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(values.cast(pa.string()), ""), _ESCAPE, r"\1\\\2\3")


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1\2\3", text)


def _raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array."""
    values = pa.concat_arrays([values]) if values.offset else values
    offsets = np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Put segment i of data at out[at[i]:]. Scatter indices are made for INDEXED bytes at once; a longer segment is one
    copy of its own."""
    lengths = np.diff(offsets)
    for i in np.flatnonzero(lengths > INDEXED):
        out[at[i] : at[i] + lengths[i]] = data[offsets[i] : offsets[i + 1]]
    short = np.flatnonzero(lengths <= INDEXED)
    groups = np.r_[0, np.cumsum(lengths[short])] // INDEXED
    cuts = np.r_[np.flatnonzero(np.diff(groups[:-1], prepend=-1)), len(short)] if len(short) else np.zeros(1, np.int64)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        own = short[low:high]
        n = lengths[own]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at[own], n) + step] = data[np.repeat(offsets[own], n) + step]


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Formatted conversations, and begins and ends of their loss spans. conv: ascending conversation number of each turn."""
    role_codes, role_names = (lambda d: (d.indices.to_numpy(), d.dictionary))(escape(roles).dictionary_encode())
    heads = pa.array([_HEAD + r.encode() + _AFTER_ROLE for r in role_names.to_pylist()], pa.binary())
    pick = heads.take(pa.array(role_codes))
    (head_data, head_off), (text_data, text_off) = _raw(pick), _raw(escape(texts))
    head_len, text_len = np.diff(head_off), np.diff(text_off)
    ends = np.cumsum(head_len + text_len + len(_FOOT))
    starts = ends - head_len - text_len - len(_FOOT)
    if ends[-1] > MOST_BYTES:
        raise ValueError(f"conversations of {ends[-1]} bytes don't fit into one cell")
    out = np.empty(int(ends[-1]), np.uint8)
    _scatter(out, starts, head_data, head_off)
    _scatter(out, starts + head_len, text_data, text_off)
    out[(ends[:, None] - len(_FOOT) + np.arange(len(_FOOT))).ravel()] = np.tile(np.frombuffer(_FOOT, np.uint8), len(ends))
    last = np.flatnonzero(np.r_[conv[1:] != conv[:-1], True])
    bounds = np.r_[0, ends[last]]
    formatted = pa.Array.from_buffers(pa.binary(), len(last), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)])
    learnt = np.flatnonzero(role_codes == next((i for i, r in enumerate(role_names.to_pylist()) if r == "assistant"), -1))
    number = np.searchsorted(last, learnt)
    list_off = pa.array(np.searchsorted(number, np.arange(len(last) + 1)), pa.int32())
    begin = (starts + head_len)[learnt] - bounds[number]
    spans = [pa.ListArray.from_arrays(list_off, pa.array(x)) for x in (begin, begin + text_len[learnt])]
    return formatted, *spans


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, piece, n_turns, formatted (binary), loss_begin, loss_end (byte spans, array<bigint>) of every conversation.
    Pieces of a conversation, if it has more than piece 0, are next to each other in the order of its turns."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def ready(rows: pa.Table, first_piece: int) -> pa.RecordBatch:
        ids = rows.column("conv_id").combine_chunks()
        codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        formatted, begin, end = assemble(codes, rows.column("role").combine_chunks(), rows.column("text").combine_chunks())
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        piece = np.where(np.arange(len(first)) == 0, first_piece, 0)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(piece), pa.array(np.diff(np.r_[first, len(codes)])), formatted, begin, end], names=["conv_id", "piece", "n_turns", "formatted", "loss_begin", "loss_end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # turns of the conversation that goes on
        size, given, pieces = 0, None, 0  # bytes held; the conversation of which pieces are given, and how many

        def give(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows)
            return ready(whole, pieces if pieces and whole.column("conv_id")[0].as_py() == given else 0)

        for whole in batches:
            for batch in slices(whole, SLICE_BYTES, ("role", "text")):
                ids = batch.column("conv_id").to_pylist()
                cut = next((i for i in range(len(ids) - 1, 0, -1) if ids[i] != ids[i - 1]), 0)
                if cut or (held and ids[0] != held[-1].column("conv_id")[-1].as_py()):
                    if held and ids[0] != held[-1].column("conv_id")[-1].as_py() and not cut:
                        yield give(held)
                    else:
                        yield give([*held, batch.slice(0, cut)])
                    held, size, given, pieces = [], 0, None, 0
                held.append(batch.slice(cut))
                size += held[-1].nbytes
                if size > PIECE_BYTES:
                    yield give(held)
                    pieces = pieces + 1 if pieces and ids[-1] == given else 1
                    held, size, given = [], 0, ids[-1]
        if held:
            yield give(held)

    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_batches(rows.select("conv_id", "role", "text"), run, f"conv_id {kind}, piece bigint, n_turns bigint, formatted binary, loss_begin array<bigint>, loss_end array<bigint>")


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of the turns, read back."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted text alone. Pieces of a
    conversation are to be next to each other, in order, as format_conversations() gives them."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list | None = None
        for batch in (part for whole in batches for part in slices(whole, SLICE_BYTES, ("formatted",))):
            out = []
            for conv, piece, text, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "formatted", "loss_begin", "loss_end")), strict=True):
                if piece == 0:
                    if own is not None:
                        out.append(own)
                    own = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    own[1] += 1
                    own[2].update(role + b"\n" + said + b"\n")
                learnt = b"".join(unescape(text[b:e]) for b, e in zip(begin, end, strict=True))
                own[3] += len(learnt.decode())
                own[4].update(learnt)
                own[5] += len(text.decode())
            if out:
                yield told(out, batch.column("conv_id").type)
        if own is not None:
            yield told([own], batch.column("conv_id").type)

    def told(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        plain = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in r] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*plain, strict=True), kinds, strict=True)], names=names)

    return map_batches(formatted.select("conv_id", "piece", "formatted", "loss_begin", "loss_end"), run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_control_case(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts consist of control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    case = turns.sparkSession.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(case)
