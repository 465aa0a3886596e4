"""Structure repair against a plain dynamic program over rows, and its grammar, ropes and defined cases."""

import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import structure_repair as S

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost bigint, key string, part bigint"


def best_edits(rows):
    """(cost, audit, repaired rows) by trying all edits of (initial, fault, role, text) rows in order."""
    states = {"": (0, "", ())}  # the initials so far, shortened to what matters

    def grow(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, a, r) in list(out.items()):
                nxt = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
                way = (c + 2, a + "I", (*r, ({"u": "user", "a": "assistant"}[nxt], "")))
                if nxt not in out or way < out[nxt]:
                    out[nxt] = way
        return out

    for initial, fault, role, text in rows:
        new = {}

        def take(s, way):
            if s not in new or way < new[s]:
                new[s] = way

        for s, (c, a, r) in grow(states).items():
            take(s, (c + 3, a + "D", r))
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                if (s, initial) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    take(initial, (c, a + "K", (*r, (role, text))))
                nxt = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
                take(nxt, (c + 2, a + "R", (*r, ({"u": "user", "a": "assistant"}[nxt], text))))
        states = new
    ends = grow(states)
    return min(ends[s] for s in ("", "a") if s in ends)


def brute(rows):
    out, convs = {}, {}
    for r in rows:
        own = convs.setdefault(r[0], [])
        role, text = (" " if x is None else x for x in r[2:4])
        kind = zlib.crc32(f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(r[1], "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, repaired = best_edits([(r[:1], f, r, t) for f, (_, r, t) in zip(faults, own, strict=True)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in S.FAULTS[1:]), illegal, cost, audit, digest)
    return out


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def invented(seed, convs, turns):
    rng = random.Random(seed)
    says = ["Yes.", "No", "", " \t", "Why?", "Go on!\n", "ä…", None]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, turns)):
            rows.append((c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(says) if rng.random() < 0.6 else f"Text {rng.randint(0, 9)}.", 1, "k", 2))
    return rows


@pytest.mark.parametrize("cut", [False, True])
def test_repair(spark, monkeypatch, cut):
    if cut:  # a conversation lies in many ranges, and in many pieces of one
        monkeypatch.setattr(S, "RANGE_ROWS", 40)
        monkeypatch.setattr(S, "COMPRESSED", 12)
    rows = [*invented(1, 25, 12), *invented(2, 1, 120)]
    rows += [(None, k, "user", f"Said {k}.", 0, "", 0) for k in range(3)] + [(77, None, "user", "x", 0, "", 0), (78, 0, "assistant", "Long. " * 20_000, 0, "", 0)]
    assert found(S.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), damage=True)) == brute(rows)


def test_repair_of_the_table(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert found(S.repair(turns, damage=True)) == brute([(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()])
    assert S.repair(turns.limit(0), damage=True).count() == 0


def test_products_equal_plain_programme():
    rng = random.Random(5)
    evaluator = S.Evaluator()
    names = [bytes(rng.choices(range(16), k=rng.randint(1, 40))) for _ in range(60)]
    names += [bytes([5] * 64), bytes([4, 8] * 40), names[0] + names[1]]
    for name, matrix in evaluator.matrices(names).items():
        rows = [(S.INITIALS[s // 4], S.FAULTS[s % 4], "", "") for s in name]
        expected = best_edits(rows)
        assert S.finish({j: way for (i, j), way in matrix.items() if i == 0}) == expected[:2]


def test_rules_give_the_sequences_back():
    rng = random.Random(3)
    sequences = [[rng.randint(0, 3) for _ in range(rng.randint(1, 60))] for _ in range(40)] + [[1] * 33, [0, 1] * 20]
    rules, short = S.re_pair(sequences, 16)

    def expand(s):
        return [s] if s < 16 else expand(rules[s - 16][0]) + expand(rules[s - 16][1])

    assert [[x for s in seq for x in expand(s)] for seq in short] == sequences
    assert sum(map(len, short)) < sum(map(len, sequences)) / 2
    pairs = [p for seq in short for p in zip(seq, seq[1:], strict=False) if p[0] != p[1]]
    assert len(pairs) == len(set(pairs))


def test_ropes_compare_as_texts():
    rng = random.Random(9)

    def rope(text):
        if len(text) < 2 or rng.random() < 0.2:
            return S.Rope(text)
        k = rng.randint(0, len(text))
        return S.Rope(parts=(rope(text[:k]), rope(text[k:])))

    for _ in range(500):
        a, b = ("".join(rng.choices("DIK", k=rng.randint(0, 12))) for _ in range(2))
        b = rng.choice([b, a, a + "K", a[:-1]])
        assert str(rope(a)) == a and S.before(rope(a), rope(b)) == (a < b)
