"""Toxicity by multiple-instance learning: sentences are scored, noisy-or makes a document's score of them.

A sentence's logit is a bias plus the weights of its words and of their first four and five bytes; a document is toxic
with probability 1 - prod(1 - p_s). The weights are trained from document labels alone (full-batch proximal gradient
steps on the noisy-or likelihood), and then locate the offending sentences. Words and beginnings are 32-bit hashes; A-Z
count as a-z, and full stops, exclamation and question marks and line ends part sentences.

Defined cases: null, empty and wordless texts score the probability of an empty document, 0.0; rows that repeat score
alike; without labels every score is 0.0; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, labelled_sample, learnable, map_arrow, score_texts, texts_of

#: Labelled documents read for training at most: of label 1, and of label 0.
SAMPLE = (1500, 3000)
#: A word or beginning is a feature if so many documents of the sample have it.
LEAST_DOCUMENTS = 4
STEPS = 160
_END = b"\x01"
_TABLE = bytes(1 if c in b".!?\n" else 32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c + 32 if 65 <= c < 91 else c for c in range(256))


def _tokens(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).replace(_END, b" \x01 ").split()


def _features(token: bytes) -> tuple[int, int, int]:
    return xxhash.xxh32_intdigest(token), xxhash.xxh32_intdigest(token[:4], 4), xxhash.xxh32_intdigest(token[:5], 5)


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[int, float]
    _memory: dict[bytes, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weights": self.weights, "_memory": {}}

    def _weight(self, token: bytes) -> float:
        w = sum(self.weights.get(f, 0.0) for f in _features(token))
        if len(self._memory) < 150_000:
            self._memory[token] = w
        return w

    def sentence_logits(self, text: bytes) -> np.ndarray:
        """Logits of the sentences that have words, in order."""
        tokens = _tokens(text)
        if not tokens:
            return np.empty(0)
        self._memory.setdefault(_END, float("nan"))
        get, make = self._memory.get, self._weight
        w = np.array([x if (x := get(t)) is not None else make(t) for t in tokens])
        ends = np.isnan(w)
        sentence = np.cumsum(ends) - ends
        words = ~ends
        has = np.bincount(sentence[words], minlength=int(sentence[-1]) + 1) > 0
        return (self.bias + np.bincount(sentence[words], w[words], minlength=len(has)))[has]

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.array([-np.expm1(-np.logaddexp(0, self.sentence_logits(t)).sum()) if t else 0.0 for t in texts])


def noisy_or(z: np.ndarray, doc_of: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the documents' labels y, and its gradient by the sentences' logits z: a document is toxic
    with probability 1 - prod(1 - p_s) over its sentences."""
    a = np.bincount(doc_of, np.logaddexp(0, z), minlength=len(y))
    loss = float((weight * np.where(y > 0.5, -np.log(-np.expm1(-np.maximum(a, 1e-6))), a)).sum())
    slope = np.where(y > 0.5, -1 / np.expm1(np.clip(a, 1e-6, 50)), 1.0) * weight
    return loss, slope[doc_of] / (1 + np.exp(-z))


def train(rows: list[tuple[float, float, bytes]]) -> ToxicityModel:
    """rows: label, weight, and the tokens of a document as _instances() packs them."""
    tokens = [np.frombuffer(t, np.uint32).reshape(-1, 4) for _, _, t in rows]
    used = [i for i, t in enumerate(tokens) if len(t)]
    y, weight = (np.array([rows[i][k] for i in used]) for k in (0, 1))
    if not used or y.min() == y.max():
        return ToxicityModel(float("-inf"), {})
    tokens = [tokens[i] for i in used]
    n = len(tokens)
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in tokens])
    flat = np.concatenate(tokens)
    sentence = np.r_[0, np.cumsum((flat[1:, 3] != flat[:-1, 3]) | (doc[1:] != doc[:-1]))].astype(np.int32)
    doc_of = doc[np.r_[True, sentence[1:] != sentence[:-1]]]
    words, feature, at = [], [], []
    for k in range(3):
        own, inverse = np.unique(flat[:, k], return_inverse=True)
        once = np.unique(inverse.astype(np.int64) * n + doc) // n
        common = np.bincount(once, minlength=len(own)) >= LEAST_DOCUMENTS
        keep = common[inverse]
        feature.append((np.cumsum(common) - 1)[inverse[keep]].astype(np.int32) + sum(map(len, words)))
        words.append(own[common])
        at.append(sentence[keep])
    words, feature, at = np.concatenate(words), np.concatenate(feature), np.concatenate(at)
    d, m = len(words), len(doc_of)
    theta, bias = np.zeros(d), -6.0
    square, square_b = np.full(d, 1e-10), 1e-10
    weight = weight / weight.sum()
    for _ in range(STEPS):
        z = bias + np.bincount(at, theta[feature], minlength=m)
        g = noisy_or(z, doc_of, y, weight)[1]
        grad, grad_b = np.bincount(feature, g[at], minlength=d), g.sum()
        square, square_b = square + grad**2, square_b + grad_b**2
        rate = 0.5 / np.sqrt(square)
        theta = theta - rate * grad
        theta = np.sign(theta) * np.maximum(0, np.abs(theta) - rate * 2e-5)
        bias = min(-4.0, bias - 0.1 / np.sqrt(square_b) * grad_b)
    some = np.flatnonzero(theta)
    return ToxicityModel(float(bias), dict(zip(words[some].tolist(), theta[some].tolist(), strict=True)))


def _instances(sample: DataFrame) -> DataFrame:
    """label and tokens of each text: hashes of the word and its beginnings, and the sentence's number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = []
        for text in texts_of(batch):
            out, s = set(), 0
            for t in _tokens(text):
                if t == _END:
                    s += 1
                else:
                    out.add((s, t))
            packed.append(np.array([(*_features(t), s) for s, t in sorted(out)], np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(packed, pa.binary())], names=["label", "tokens"])

    return map_arrow(sample, "label double, tokens binary", run)


def fit(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = SAMPLE) -> ToxicityModel:
    """Learn from at most so many documents of each label; weights restore the labels' shares, outside the held-out part.
    Rows are put in an order of their own, so the model doesn't depend on how they lie in tables and tasks."""
    sizes = {r[0]: r[1] for r in learnable(labels, "toxic").groupBy("toxic").count().collect()}
    sample = labelled_sample(docs, labels, "toxic", {1: rows[0], 0: rows[1]})
    got = [(r[0], bytes(r[1])) for r in _instances(sample).collect()]
    taken = Counter(y for y, _ in got)
    return train([(y, sizes[int(y)] / taken[y], t) for y, t in sorted(got, key=lambda x: (-x[0], zlib.crc32(x[1]), x[1]))])


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score_texts(docs, model.score)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, sentence (its number among the sentences with words) and score of the sentences that score so high."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, s, p) for i, t in enumerate(texts_of(batch)) for s, p in enumerate(1 / (1 + np.exp(-model.sentence_logits(t)))) if p >= threshold]
        take = pa.array([r[0] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), pa.array([r[1] for r in rows], pa.int64()), pa.array([float(r[2]) for r in rows], pa.float64())], names=["doc_id", "sentence", "score"])

    return map_arrow(docs.select("doc_id", "text"), f"doc_id {kind}, sentence bigint, score double", run)
