"""Licence scans: ordered signature rules, gated by keywords; priority and containment resolve overlaps.

Every whole text is put in lower case (A-Z). The base phrases are counted wherever their words stand one after the
other. Rules run only where a keyword that their matches contain occurs; a detection that lies inside one of a rule of higher priority is
dropped, and so is one that overlaps such a detection and is not longer. Labels of what is left join the base labels;
the score is the weight of the best statement found.

Defined cases: null texts count as empty and have no words and no labels; repeated rows give repeated results; an empty
table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import map_arrow, texts_of
from tidemark.llm.license_rules import _GAP, RULES, Rule

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PHRASES = [(label, phrase.split()[0].encode(), re.compile(rb"(?<![0-9a-z\x80-\xff])" + _GAP.encode().join(w.encode() for w in phrase.split()) + rb"(?![0-9a-z\x80-\xff])")) for phrase, label in BASE.items()]
#: Rules by keyword; those without one are always tried.
_BY_KEYWORD = {k: [i for i, r in enumerate(RULES) if k in r.keywords] for k in sorted({k for r in RULES for k in r.keywords})}
_ALWAYS = [i for i, r in enumerate(RULES) if not r.keywords]


def candidates(low: bytes) -> list[Rule]:
    """The rules that may match a text in lower case, from the highest priority."""
    return [RULES[i] for i in sorted({*_ALWAYS, *(i for k, own in _BY_KEYWORD.items() if k in low for i in own)})]


def detections(low: bytes) -> list[tuple[int, int, str, float]]:
    """begin, end, label, weight of what is left after suppression, of a text in lower case.

    A detection goes if a kept one that it overlaps is as long or longer, which includes all that contain it. `longest` has
    for each byte the length of the longest kept detection there, so a detection looks at its own bytes alone.
    """
    kept: list[tuple[int, int, str, float]] = []
    longest = None
    for rule in candidates(low):
        for m in rule.pattern.finditer(low):
            b, e = m.span()
            if longest is None:
                longest = np.zeros(len(low), np.int32)
            own = longest[b:e]
            if e > b and own.max() < e - b:
                own[:] = e - b  # all of it was less
                kept.append((b, e, rule.label, rule.weight))
    return sorted(kept)


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[int, int, str, float]]]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections of a text."""
    low = text.lower()
    word = _WORD[np.frombuffer(low, np.uint8)]
    start = word.copy()
    start[1:] &= ~word[:-1]
    places, base = [], set()
    for label, first, pattern in _PHRASES:
        if first in low:
            for m in pattern.finditer(low):
                places.append(m.start())
                base.add(label)
    at = [int(np.count_nonzero(start[:p])) for p in (min(places), max(places))] if places else [None, None]
    found = detections(low)
    labels = base | {d[2] for d in found}
    score = max([0.7] * bool(base) + [d[3] for d in found], default=0.0)
    return int(np.count_nonzero(start)), len(places), at[0], at[1], ",".join(sorted(base)), ",".join(sorted(labels)), score, found


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (begin, end and label of the detections, in bytes) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("label", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t) for t in texts_of(batch)]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        spans = pa.array([[{"begin": b, "end": e, "label": x} for b, e, x, _ in r[7]] for r in rows], pa.list_(span))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, spans], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return map_arrow(docs.select("doc_id", "text"), f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<begin: bigint, end: bigint, label: string>>", run)
