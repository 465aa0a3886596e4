"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams (one to three characters, lower case) are counted over all documents that may be
learnt from. A bounded sample of them trains the weights by follow-the-regularised-leader with an elastic net, so most
weights are zero; a fifth of it calibrates a temperature. Scoring sums weights over the n-grams of whole texts.

Defined cases: null texts and texts without a letter are `und`, score 0.0; rows without a language take no part in
learning; without any, all is `und`; rows that repeat score alike; an empty table gives an empty result; other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, map_arrow, map_batches, slices, sliced, summed

WIDTH = 1 << 16
ORDERS = 3
#: Documents for training at most, dealt evenly to the languages.
SAMPLE = 3000
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 4, 0.5, 1.0, 0.002, 0.001, 10.0
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngrams(text: str) -> np.ndarray:
    """Hashed n-grams of all orders, one for each place."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out = []
    h = np.zeros(len(c), np.uint32)
    for n in range(min(ORDERS, len(c))):
        h = h[: len(c) - n] * np.uint32(31) + c[n:] * _MIX[n] + np.uint32(n + 1)
        out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16))
    return np.concatenate(out).astype(np.uint16) if out else np.empty(0, np.uint16)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (WIDTH, languages), inverse document frequencies and scale included
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            g = ngrams(text)
            out[i] = self.bias
            for at in range(0, len(g), 200_000):
                out[i] += self.weights[g[at : at + 200_000]].sum(axis=0, dtype=np.float64) / len(g)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(self.languages) and has_letter(t) for t in texts], bool)
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if known.any():
            at = np.flatnonzero(known)
            z = self.logits([texts[i] for i in at]) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            scores[at] = p.max(axis=1)
            for i, k in zip(at, p.argmax(axis=1), strict=True):
                names[i] = self.languages[k]
        return names, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max())
    return p / p.sum()


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> LanguageModel:
    """rows: language, distinct n-grams, their share of the text's n-grams."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((WIDTH, 0), np.float32), np.zeros(0), 1.0)
    k = len(languages)
    z, n = np.zeros((WIDTH + 1, k)), np.zeros((WIDTH + 1, k))  # the last row is the bias

    def weights(at: np.ndarray) -> np.ndarray:
        own, sums = z[at], np.sqrt(n[at])
        return np.where(np.abs(own) <= L1, 0, -(own - np.sign(own) * L1) / ((BETA + sums) / ALPHA + L2))

    data = [(languages.index(y), np.append(g, WIDTH), np.append(SCALE * tf * idf[g], 1.0)) for y, g, tf in rows]
    apart = [d for i, d in enumerate(data) if i % 5 == 4] or data
    learn = [d for i, d in enumerate(data) if i % 5 != 4] or data
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(learn)):
            y, at, x = learn[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / ALPHA * w
            n[at] = n_new
    full = weights(np.arange(WIDTH + 1))
    held = [(y, x @ full[at]) for y, at, x in apart]
    grid = np.geomspace(0.05, 5, 60)
    loss = [sum(-np.log(_softmax(v / t)[y] + 1e-12) for y, v in held) for t in grid]
    return LanguageModel(languages, (SCALE * idf[:, None] * full[:WIDTH]).astype(np.float32), full[WIDTH], float(grid[int(np.argmin(loss))]))


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequencies of the hashed n-grams, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, has = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, bool)
        for part in (p for b in batches for p in slices(b)):
            for text in part.column("text").to_pylist():
                has[:] = False
                has[ngrams(text or "")] = True
                df += has
        parts = sliced(df)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    return summed(map_batches(docs.select("text"), run, "slice int, counts binary"), WIDTH), docs.count()


def fit(docs: DataFrame, rows: int = SAMPLE, modulus: int = 4, remainder: int = 2) -> LanguageModel:
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)).select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    df, n = _frequencies(usable)
    idf = np.log((1 + n) / (1 + df)) + 0.05
    if not sizes:
        return train([], idf)
    quota = max(1, rows // len(sizes))
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, quota / v)))])
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, shares = [], []
        for text in batch.column("text").to_pylist():
            g, c = np.unique(ngrams(text), return_counts=True)
            grams.append(g.tobytes())
            shares.append((c / max(1, c.sum())).astype(np.float32).tobytes())
        return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(grams, pa.binary()), pa.array(shares, pa.binary())], names=["lang", "grams", "shares"])

    found = map_arrow(chosen.select("lang", "text"), "lang string, grams binary, shares binary", run).collect()
    found = [(r[0], np.frombuffer(r[1], np.uint16).astype(np.int64), np.frombuffer(r[2], np.float32).astype(float)) for r in found]
    return train([r for r in found if len(r[1])], idf)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_language(docs.select("doc_id", "text"), ["doc_id"], f"doc_id {kind}", model)


def _with_language(docs: DataFrame, keep: list[str], kinds: str, model: LanguageModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return map_arrow(docs, f"{kinds}, lang_pred string, score double", run)


def keep_identified(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The rows whose language is found with such a score; `und` rows go. All columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(batch.column("text").to_pylist())
        return batch.filter(pa.array((np.array(names, object) != "und") & (scores >= least)))

    return map_arrow(docs, docs.schema, run)
