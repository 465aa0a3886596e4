"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (character classes, word lengths, repetition, line shapes) are binned at quantiles of a
bounded labelled sample; each tree grows level by level from sums of gradients in the bins. The forest is flattened
into arrays, and all rows of a batch walk all trees at once.

Defined cases: null and empty texts have all statistics 0 and are scored like any text; values beyond the sample's fall
into the outer bins; rows that repeat score alike; without labels every score is 0.5; an empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, labelled_sample, map_arrow, score_texts, texts_of

#: Labelled documents read for training at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 60, 4, 64, 0.2, 1.0, 1.0

STATISTICS = [
    "log_bytes", "log_words", "word_length", "upper", "lower", "digit", "space", "other_bytes", "full_stops", "commas", "exclamations", "pipes",
    "symbols", "distinct_words", "distinct_words_by_root", "repeated_neighbours", "log_lines", "line_length", "distinct_lines", "upper_words", "longest_word",
]
_CLASSES = np.zeros((256, 9), np.float64)
for _k, _chars in enumerate([range(65, 91), range(97, 123), range(48, 58), b" \t\n\r", range(128, 256), b".", b",", b"!", b"|"]):
    _CLASSES[list(_chars), _k] = 1
_SYMBOLS = np.zeros(256)
_SYMBOLS[list(b"#$%&*+/<=>@\\^_`{}~[]()")] = 1


def statistics(text: bytes) -> list[float]:
    """One value for each of STATISTICS."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    upper, lower, digit, space, other, stops, commas, shouts, pipes = (counts @ _CLASSES / n).tolist()
    words = text.split()
    w = max(1, len(words))
    distinct, same = len(set(words)), sum(map(operator.eq, words, words[1:]))
    lines = text.split(b"\n")
    return [
        np.log1p(n), np.log1p(len(words)), (n * (1 - space)) / w, upper, lower, digit, space, other, stops, commas, shouts, pipes,
        float(counts @ _SYMBOLS) / n, distinct / w, distinct / np.sqrt(w), same / w, np.log1p(len(lines)), n / len(lines), len(set(lines)) / len(lines),
        sum(map(bytes.isupper, words)) / w, float(max(map(len, words), default=0)),
    ]


@dataclass
class Forest:
    """Flattened trees: node i of tree t at t * nodes + i, its children at 2 i + 1 and 2 i + 2; a leaf leads to itself."""

    base: float
    nodes: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    leaf: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Rows walk all trees at once, one level at a time."""
        trees = len(self.feature) // self.nodes if self.nodes else 0
        if not trees or not len(x):
            return np.full(len(x), self.base)
        first = np.arange(trees) * self.nodes
        node = np.zeros((len(x), trees), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = first + node
            down = 2 * node + 1 + (x[rows, self.feature[at]] > self.threshold[at])
            node = np.where(self.leaf[at], node, down)
        return self.base + self.value[first + node].sum(axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(np.array([statistics(t) for t in texts]).reshape(len(texts), -1))))


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees on logistic loss."""
    if len(y) == 0 or y.min() == y.max():
        base = 0.0 if len(y) == 0 else float(np.clip(40 * (2 * y[0] - 1), -40, 40))
        return Forest(base, 0, *(np.empty(0, t) for t in (np.int64, float, float, bool)))
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin b: cuts[b-1] < x <= cuts[b]
    nodes = 2 ** (DEPTH + 1) - 1
    base = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(n, base)
    parts: list[list[np.ndarray]] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        feature, threshold, value, leaf = np.zeros(nodes, np.int64), np.zeros(nodes), np.zeros(nodes), np.ones(nodes, bool)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH + 1):
            first, width = 2**level - 1, 2**level
            live = node >= first
            own = node[live] - first
            sg, sh = np.bincount(own, g[live], minlength=width), np.bincount(own, h[live], minlength=width)
            value[first : first + width] = -RATE * sg / (sh + RIDGE)
            if level == DEPTH or not live.any():
                break
            best, choice = np.full(width, 1e-6), np.full((width, 2), -1)
            for j in range(d):
                if not len(cuts[j]):
                    continue
                key = own * BINS + binned[live, j]
                left_g = np.bincount(key, g[live], minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)[:, : len(cuts[j])]
                left_h = np.bincount(key, h[live], minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)[:, : len(cuts[j])]
                right_g, right_h = sg[:, None] - left_g, sh[:, None] - left_h
                gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - (sg**2 / (sh + RIDGE))[:, None]
                gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = -1
                b = gain.argmax(axis=1)
                better = gain[np.arange(width), b] > best
                best[better], choice[better] = gain[np.arange(width), b][better], np.stack([np.full(width, j), b], axis=1)[better]
            for k in np.flatnonzero(choice[:, 0] >= 0):
                i, (j, b) = first + k, choice[k]
                feature[i], threshold[i], leaf[i] = j, cuts[j][b], False
            moves = live & ~leaf[node]
            node[moves] = 2 * node[moves] + 1 + (x[moves, feature[node[moves]]] > threshold[node[moves]])
        f += value[node]
        parts.append([feature, threshold, value, leaf])
    return Forest(base, nodes, *(np.concatenate(c) for c in zip(*parts, strict=True)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Forest:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array([np.array(statistics(t)).tobytes() for t in texts_of(batch)], pa.binary())], names=["label", "statistics"])

    found = map_arrow(labelled_sample(docs, labels, "quality", rows), "label double, statistics binary", run).collect()
    x = np.array([np.frombuffer(r[1]) for r in found]).reshape(len(found), len(STATISTICS))
    return boost(x, np.array([float(r[0] > 0.5) for r in found]))


def score_documents(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score_texts(docs, forest.score)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
