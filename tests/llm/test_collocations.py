"""Collocations against plain counting, Misra-Gries summaries against their guarantee, and defined cases."""

import collections
import random
import re

import numpy as np
import pytest

from tests.llm.test_operators import documents, lower, odd
from tidemark.llm import collocations as C

SCHEMA = "doc_id bigint, lang string, text string, n bigint, a bigint, phrase string, rank bigint"


def brute(rows, threshold, longest=5, percent=100, top=2000):
    f, n, out = collections.Counter(), collections.Counter(), []
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r.text)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {k: v for k, v in f.items() if v >= threshold and len(k[1]) > 1}
    inside = collections.defaultdict(int)
    for (lang, words), v in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inside[lang, words[i : i + k]] = max(inside[lang, words[i : i + k]], v)
    for (lang, words), a in candidates.items():
        if 100 * inside[lang, words] >= percent * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
        out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], n[lang]))
    ranks, ranked = collections.Counter(), []
    for lang, score, a, phrase, l, r, total in sorted(out):  # noqa: E741
        ranks[lang] += 1
        if ranks[lang] <= top:
            ranked.append((lang, ranks[lang], phrase.decode(), -a, l, r, total, -score))
    return sorted(ranked)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("threshold, percent, top", [(100, 100, 2000), (12, 100, 40), (12, 70, 2000)])
def test_documents(spark, sf_dir, threshold, percent, top):
    docs = documents(spark, sf_dir)
    expected = brute(docs.collect(), threshold, percent=percent, top=top)
    assert expected and found(C.collocations(docs, threshold, 5, percent, top)) == expected


def test_repetitions_and_langs(spark, monkeypatch):
    for name, value in (("PARTITION_CHARS", 20_000), ("GATHERED", 50), ("WORDS", 5), ("COUNTED", 3), ("CELLS_HELD", 4)):
        monkeypatch.setattr(C, name, value)
    rng = random.Random(4)
    texts = ["a a a a a a, b a", "New York\tCity is new york. City!", "", None, "x y\nx y\rx y", "Ä ä Ä ä", "a-b_c 'q' 'q' 'q'", "w" * 5000 + " z " + "w" * 5000 + " z"]
    rows = [(i, rng.choice(["en", None, "und", "ü"]), rng.choice(texts), 1, 2, "p", 3) for i in range(120)]
    docs = spark.createDataFrame([*rows, rows[0], (None, None, None, None, None, None, None)], SCHEMA).repartition(5)
    for longest in (2, 3, 5):
        expected = brute(docs.collect(), 7, longest)
        assert expected and found(C.collocations(docs, 7, longest)) == expected


def test_odd_and_empty(spark):
    docs = odd(spark)
    assert found(C.collocations(docs, 2)) == brute(docs.collect(), 2)
    assert C.collocations(docs.limit(0), 2).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_summaries_keep_what_is_frequent(seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    drawn = keys[np.minimum(rng.zipf(1.3, 60_000) - 1, 2999)]
    threshold, partitions = 200, 16
    mass = np.bincount(C.partition_of(drawn, partitions), minlength=partitions)
    capacity = mass // threshold + 1
    true = dict(zip(*np.unique(drawn, return_counts=True), strict=True))
    merged = C.Summary(capacity, partitions)
    for task in np.array_split(drawn, 7):
        own = C.Summary(capacity, partitions)
        for part in np.array_split(task, 5):
            own.add(*np.unique(part, return_counts=True))
        merged.add(own.keys, own.counts)
        merged.error += own.error
    assert (np.bincount(C.partition_of(merged.keys, partitions), minlength=partitions) <= capacity).all()
    assert merged.error.max() > 0 and (merged.error < threshold).all()
    counts = dict(zip(merged.keys, merged.counts, strict=True))
    for key, n in true.items():
        error = merged.error[C.partition_of(np.array([key]), partitions)[0]]
        assert counts.get(key, 0) <= n <= counts.get(key, 0) + error
        if n >= threshold:
            assert key in counts


def test_equal_hashes_are_told_apart():
    lexicon = C.Lexicon()
    words = C.words_of([b"a b a c a b"], ["en"], lexicon)
    at = np.array([0, 2, 4])
    got = collections.Counter()
    for lang, phrase, n in C._exact(words, at, np.zeros(3, np.uint64), 2):
        got[lang, phrase] += n
    assert got == {("en", b"a b"): 2, ("en", b"a c"): 1}


def test_exact_counts_travel_packed(spark):
    """Rows of the exact count go with tasks, langs and partitions, not with phrases; sums stay those of the words."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") for _ in range(200)), rng.choice(["x", "y\n"])) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None, "z"), (61, "", "z")], "id int, text string, lang string").filter("text IS NOT NULL").select("lang", "text").repartition(3)
    true = collections.Counter((lang, p) for _, text, lang in rows for k in (1, 2) for p in [" ".join(w) for w in zip(*(text.split()[j:] for j in range(k)), strict=False)])
    parts = C.counted(docs, 2, np.full(1 << 14, 255, np.uint8), 4)
    assert parts.count() <= 3 * 2 * (4 + 1) < len(true)
    got = {(r.lang, r.phrase): r.n for r in C.summed(parts, 3, 4).collect()}
    assert got == {k: n for k, n in true.items() if n >= 3} | {(lang, None): 200 * sum(r[2] == lang for r in rows) for lang in ("x", "y\n")}


@pytest.mark.parametrize("slice_cells, partitions", [(1 << 16, 16), (64, 16), (1 << 16, 1 << 10)])
def test_cells_below_the_threshold_go(spark, monkeypatch, slice_cells, partitions):
    monkeypatch.setattr(C, "SLICE_CELLS", slice_cells)
    cells, rng = 1 << 16, np.random.default_rng(8)
    keys = rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)
    drawn = keys[np.minimum(rng.zipf(1.3, 50_000) - 1, 3999)]
    rows, masses = [], C.Masses(cells)
    for task in np.array_split(drawn, 6):
        for part in np.array_split(task, 3):
            masses.add(part)
        rows += [[*r] for r in masses.rows()]
        assert not len(masses.cells)
    bits, mass = C.frequent_cells(spark.createDataFrame(rows, "part int, keys binary, counts binary").repartition(3), 30, cells, partitions)
    true = np.bincount(C.partition_of(drawn, cells), minlength=cells)
    assert (np.unpackbits(bits).astype(bool) == (true >= 30)).all() and 0 < (true >= 30).sum() < (true > 0).sum()
    assert (mass == np.where(true >= 30, true, 0).reshape(partitions, -1).sum(axis=1)).all()
    assert (C.in_cells(bits, keys) == (true[C.partition_of(keys, cells)] >= 30)).all()


@pytest.mark.parametrize("block", [3, 1 << 18])
def test_words_and_what_follows(monkeypatch, block):
    monkeypatch.setattr(C, "SLICE_BYTES", 5)
    monkeypatch.setattr(C, "BLOCK", block)
    C._powers.cache_clear()
    texts = ["", "..", "Ab\tcd ef. gh", "a" * 30 + " b  c\x0bd?", "x y z Ä ba ab", " ", "one.two b", "cd AB " + "a" * 30 + "!x"]
    got = C.words_of([t.encode() for t in texts], list("pqpqprpq"), C.Lexicon())
    pieces = [(lang, re.findall(r"[^\x20\x09]+", piece)) for lang, t in zip("pqpqprpq", texts, strict=True) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t))]
    expected = [(lang, words[i].encode(), len(words) - i) for lang, words in pieces for i in range(len(words))]
    assert [(got.langs[a], got.lexicon.words[b], c) for a, b, c in zip(got.lang, got.ids, got.left, strict=True)] == expected
    of = dict(zip(got.ids.tolist(), got.hashes.tolist(), strict=True))
    assert [of[i] for i in got.ids.tolist()] == got.hashes.tolist() and len(set(of.values())) == len({x[1] for x in expected})
    assert not len(C.words_of([], [], C.Lexicon()).ids)
    C._powers.cache_clear()
