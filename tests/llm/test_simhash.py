"""SimHash fingerprints and groups against brute force, and their defined cases."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import documents, lower, odd, union_find
from tidemark.llm import simhash as S


def plain(text, n=4):
    words = [w.encode() for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, bits=4):
    fps = [plain(r.text) for r in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    comp = union_find(range(len(fps)), links)
    least = {}
    for i, r in enumerate(rows):
        had = least.get(comp[i])
        least[comp[i]] = r.doc_id if had is None else had if r.doc_id is None else min(had, r.doc_id)
    return sorted(((r.doc_id, f"{f:016x}", least[comp[i]]) for i, (r, f) in enumerate(zip(rows, fps, strict=True))), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components_of_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = found(S.simhash_components(docs))
    assert out == brute(docs.collect()) and any(r[0] != r[2] for r in out)


def test_odd_and_empty(spark):
    docs = odd(spark)
    assert found(S.simhash_components(docs)) == brute(docs.collect())
    assert S.simhash_components(docs.limit(0)).count() == 0
    kept = S.drop_simhash_copies(docs.withColumns({"fp": F.lit(1), "size": F.lit(2), "rep": F.lit(3)}))
    assert kept.columns[-3:] == ["fp", "size", "rep"] and sum((r.text or "").startswith("a b c") for r in kept.collect()) == 1


def test_many_words_in_pieces(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(5000)).encode()
    whole = plain(text.decode())
    assert S.fingerprint(text) == whole
    monkeypatch.setattr(S, "PIECE_BYTES", 50)
    monkeypatch.setattr(S, "COUNTED", 7)
    assert S.fingerprint(text) == whole
    assert S.fingerprint(b"x" * 3_000_000) == plain("x" * 3_000_000)


def near_keys(seed, bases=15, most=40):
    rng = np.random.default_rng(seed)
    out = [0, 1, 2**64 - 1]
    for base in rng.integers(0, 2**63, bases).tolist():
        for _ in range(rng.integers(1, most)):
            key = base * 2
            for bit in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                key ^= 1 << bit
            out.append(key)
    return sorted(set(out))


def brute_groups(keys, bits, among=lambda a, b: True):
    return union_find(keys, [(a, b) for a in keys for b in keys if a < b and (a ^ b).bit_count() <= bits and among(a, b)])


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("bits", [0, 1, 4, 7])
def test_forest(seed, bits, monkeypatch):
    monkeypatch.setattr(S, "LEAF", 3)
    monkeypatch.setattr(S, "HELD", 50)
    monkeypatch.setattr(S, "GATHERED", 20)
    keys = near_keys(seed)
    x = np.array(keys, np.uint64)
    links = lambda a, b: list(zip(a.tolist(), b.tolist(), strict=True))
    assert union_find(keys, links(*S.forest(x, None, bits))) == brute_groups(keys, bits)
    low, high = x[x < 2**63], x[x >= 2**63]
    for pair in ((low, high), (high, low)):
        a, b = S.forest(*pair, bits)
        assert union_find(keys, links(a, b)) == brute_groups(keys, bits, lambda p, q: (p < 2**63) != (q < 2**63))
        assert len(a) < len(keys)


def test_pairs_of_subtrees(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_SUBTREE", 8)
    monkeypatch.setattr(S, "SHARE", 1000)
    monkeypatch.setattr(S, "MOST_SUBTREE", 8)
    keys = near_keys(40, 30) + [7 << 40 | i for i in range(100)]
    keys = sorted(set(keys))
    df = spark.createDataFrame([(k - (1 << 64) if k >= 1 << 63 else k,) for k in keys], "fp bigint").repartition(3)
    nodes = S.subtrees(df, len(keys), 8)
    held = [sum(k >> (64 - d) == p for k in keys) for p, d in nodes]
    assert sum(held) == len(keys) and max(held) <= 8 and min(held) > 0
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.linked(df, len(keys), 4).collect()]
    assert union_find(keys, links) == brute_groups(keys, 4)


def test_dense_group_gives_few_links():
    x = np.arange(1 << 14, dtype=np.uint64) << np.uint64(20)
    a, _ = S.forest(x, None, 4)
    assert len(a) == len(x) - 1
