"""Corpus operators against brute force, exact round trips and held-out labels, and their defined edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import chat_format, common, decontamination, language_id, license_scan, line_dedup, ngram_join, quality, sentencepiece_codec, toxicity
from tidemark.llm.common import map_batches
from tidemark.llm.exact_dedup import drop_exact_copies, exact_groups
from tidemark.llm.queries import queries, tokenizer_path
from tidemark.llm.sentencepiece_codec import Codec, digest_documents, encode_documents

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, h string"
ODD = [None, "", "   ", "\n\n", "word", "one two three", "ä" * 30, "x " * 4000, "a b c d e f g\nMIT License", "a b c d e f g\nMIT License"]


def odd(spark):
    """Nulls, empty and long texts, ties, a repeated row, and columns whose names clash."""
    rows = [(i, t, None if i % 3 else "en", None, None, 0.5, "h") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, None, None, None, None, None, None)], SCHEMA).repartition(3)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# exact dedup


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("make", ["odd", "documents"])
def test_exact_groups(spark, sf_dir, make):
    docs = odd(spark) if make == "odd" else documents(spark, sf_dir)
    assert collections.Counter(map(tuple, exact_groups(docs).collect())) == brute_groups(docs.collect())


def test_exact_hot_group(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "if(id % 3 = 0, 'same', concat('t', id div 2)) text")
    assert collections.Counter(map(tuple, exact_groups(docs).collect())) == brute_groups(docs.collect())


def test_exact_stage(spark):
    kept = drop_exact_copies(odd(spark))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for t in ODD})


# n-gram Jaccard join


def brute_components(rows):
    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", lower(text))
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {r.doc_id: shingles(r.text) for r in rows}
    index, links = collections.defaultdict(list), []
    for i in sorted(sets):
        common = collections.Counter(j for g in sets[i] for j in index[g])
        links += [(i, j) for j, k in common.items() if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k)]
        for g in sets[i]:
            index[g].append(i)
    comp = union_find(sets, links)
    return {i: (i, len(s), comp[i]) for i, s in sets.items()}


def near_copies(seed, bases, copies, words):
    """Families of edited copies around the threshold, and a passage that all share."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = [r.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(bases):
        base = shared + [r.choice(vocabulary) for _ in range(r.randint(3, words))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 14))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(own[: r.randint(int(len(own) * 0.85), len(own))])))
    return rows


@pytest.mark.parametrize(("seed", "bases", "copies", "words"), [(1, 12, 25, 120), (2, 3, 120, 60), (3, 150, 2, 12)])
def test_components(spark, seed, bases, copies, words):
    docs = spark.createDataFrame(near_copies(seed, bases, copies, words), "doc_id bigint, text string").repartition(5)
    found = {r.doc_id: tuple(r) for r in ngram_join.jaccard_components(docs).collect()}
    assert found == brute_components(docs.collect())


def test_components_of_hot_lists(spark, monkeypatch):
    """Lists that are dealt over tasks give the same components: a passage that all share, and large families."""
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 16)
    monkeypatch.setattr(ngram_join, "HOT_TIMES", 0)
    docs = spark.createDataFrame(near_copies(6, 4, 60, 50), "doc_id bigint, text string").repartition(5)
    found = {r.doc_id: tuple(r) for r in ngram_join.jaccard_components(docs).collect()}
    assert found == brute_components(docs.collect())


@pytest.mark.parametrize("pairs_a_row", [0, 10**9])
def test_components_of_lists_in_cells(spark, monkeypatch, pairs_a_row):
    """Lists that are cut into cells give the same components, with rounds of one member against the rest and without."""
    monkeypatch.setattr(ngram_join, "CELL", 3)
    monkeypatch.setattr(ngram_join, "PAIRS_A_ROW", pairs_a_row)
    docs = spark.createDataFrame(near_copies(7, 3, 14, 60), "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: tuple(r) for r in ngram_join.jaccard_components(docs).collect()}
    assert found == brute_components(docs.collect())


def test_cells_give_each_pair_once(spark):
    sizes = {1: 1, 2: 512, 3: 513, 4: 1500}
    members = spark.createDataFrame([(k, n, i) for k, n in sizes.items() for i in range(n)], "sh bigint, t bigint, x bigint")
    left, right = members.withColumnRenamed("x", "a"), members.withColumnRenamed("x", "b")
    met = ngram_join._met(left, right, False).groupBy("sh").agg(F.count("a").alias("n"), F.count_distinct("a", "b").alias("m"), F.count_distinct("row", "col").alias("cells"))
    assert {r.sh: tuple(r)[1:] for r in met.collect()} == {1: (1, 1, 1), 2: (512**2, 512**2, 1), 3: (513**2, 513**2, 4), 4: (1500**2, 1500**2, 9)}
    one = ngram_join._met(left.filter("a = 0"), right, True).groupBy("sh").count()
    assert {r.sh: r["count"] for r in one.collect()} == sizes


@pytest.mark.parametrize("fold", [1, 1 << 18])
def test_filter_of_repeated_hashes(spark, monkeypatch, fold):
    """A hash that occurs twice, in one task or in two, is in the filter; few others are."""
    monkeypatch.setattr(common, "_FOLD", fold)
    hashes = spark.range(3000).selectExpr("xxhash64(id) AS h").unionByName(spark.range(100).selectExpr("xxhash64(id * 7) AS h")).repartition(4)
    packed = common.build_filter(hashes, common.filter_bits(3100), True)
    rows = [r.h for r in hashes.collect()]
    twice = {h for h, n in collections.Counter(rows).items() if n > 1}
    held = {h for h in rows if common.may_hold(packed, np.array([h], np.int64))[0]}
    assert len(twice) == 100 and twice <= held and len(held) < 200


def test_components_of_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assert {r.doc_id: tuple(r) for r in ngram_join.jaccard_components(docs).collect()} == brute_components(docs.collect())


def test_components_odd(spark):
    found = collections.Counter(map(tuple, ngram_join.jaccard_components(odd(spark)).collect()))
    assert found[(None, 0, None)] == 1 and found[(1, 0, 1)] == 1 and found[(4, 1, 4)] == 2 and found[(9, 5, 8)] == 1
    assert sum(found.values()) == len(ODD) + 2
    kept = ngram_join.drop_near_copies(odd(spark))
    assert len(kept.columns) == 7 and 9 not in {r.doc_id for r in kept.collect()}


# line dedup


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_lines(rows):
    places = sorted((r.doc_id, k, line) for r in {(x.doc_id, x.text): x for x in rows}.values() for k, line in enumerate((r.text or "").split("\n")) if line.strip(" "))
    gone = {(d, k) for n, (d, k, line) in enumerate(places) if any(distance_one(line, x) for _, _, x in places[:n])}
    return collections.Counter((r.doc_id, "\n".join(x for k, x in enumerate((r.text or "").split("\n")) if (r.doc_id, k) not in gone)) for r in rows)


def test_lines(spark):
    r = random.Random(5)
    lines = ["".join(r.choice("abc ") for _ in range(r.choice([1, 2, 3, 5, 9, 63, 64, 65, 66, 130]))) for _ in range(60)]
    rows = []
    for i in range(150):
        own = list(r.choice(lines))
        for _ in range(r.choice([0, 1, 1, 2])):
            at = r.randrange(len(own) + 1)
            own[at : at + r.choice([0, 1])] = r.choice(["", "a", "z"])
        rows.append((i, "".join(own) + r.choice(["", "\n", "\n" + r.choice(lines), "\n \nend" + str(i % 40)])))
    rows += [(200, None), (201, ""), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = line_dedup.dedup_lines(docs).collect()
    assert collections.Counter((r.doc_id, r.kept_text) for r in found) == brute_lines(docs.collect())
    assert all(r.n_lines == (len(r.text.split("\n")) if r.text else 0) for r in found)


def test_lines_of_null_ids(spark):
    rows = [(None, "same line\nonly here"), (1, "same line\nsame lines"), (2, "Same line\nonly there\nquite another"), (3, "sane line")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    found = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(docs).collect()}
    assert found == {None: "same line\nonly here", 1: "", 2: "quite another", 3: ""}


def test_lines_of_many_lines_and_shared_ids(spark):
    """A document of many lines, rows of one id with other texts, and columns of other meaning."""
    rows = [(1, "\n".join(f"line {i:07d} of {i * 7919 % 100003}" for i in range(20_000)), 3), (2, "here\nhere", 3), (2, "there are\nlines", 3), (3, "lines\nthere are\nmore of them", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int")
    found = {(r.doc_id, r.text[:5]): r for r in line_dedup.dedup_lines(docs).collect()}
    assert found[2, "here\n"].kept_text == "here" and found[2, "there"].kept_text == "there are\nlines" and found[3, "lines"].kept_text == "more of them"
    assert found[1, "line "].n_lines == 20_000


def test_lines_of_many_characters(spark):
    """Work grows with a line's length, not with its square: an edit in the middle, one near the end, and two edits."""
    base = "".join(chr(97 + i * i % 26) for i in range(300_000)) + "𝄞ü"
    texts = [base, base[:150_000] + "é" + base[150_001:], base[:-7] + base[-6:], "x" + base + "x", base[:9] + "+" + base[9:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    assert {r.doc_id: r.n_kept for r in line_dedup.dedup_lines(docs).collect()} == {0: 1, 1: 0, 2: 0, 3: 1, 4: 0}


def test_lines_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string")
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# texts scored by models


def test_models_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    for name, label, least in (("op1_toxicity", "toxic", 0.9), ("op2_quality_classifier", "quality", 0.98)):
        rows = queries()[name](spark, big).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
        pairs = sorted((r.score, labels[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in labels)
        ones = [i for i, (_, y) in enumerate(pairs) if y]
        auc = (sum(ones) - len(ones) * (len(ones) - 1) / 2) / (len(ones) * (len(pairs) - len(ones)))
        assert auc > least, (name, auc)


def test_language_on_held_out_rows(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in documents(spark, sf_dir.replace("0.001", "0.01")).collect()}
    rows = [r for r in queries()["op9_language_id"](spark, sf_dir.replace("0.001", "0.01")).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) > 0.97 * len(rows)


def test_models_odd(spark):
    docs, none = odd(spark), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = language_id.fit(docs)
    found = collections.Counter((r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect())
    assert found[(0, "und")] == found[(3, "und")] == 1 and sum(found.values()) == len(ODD) + 2
    assert {r.text for r in language_id.keep_identified(docs).collect()} <= {t for t in ODD if t and t.strip()}
    assert {r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert {r.score for r in quality.score_documents(docs, quality.fit(docs, none)).collect()} == {0.5}


def test_offending_sentences(spark):
    rows = [(i, f"Nice words here {i}. " + ("You utter moron! " if i % 4 == 0 else "You fine friend! ") + "The end.") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert {(r.doc_id, r.sentence) for r in toxicity.offending_sentences(docs, model).collect()} == {(i, 1) for i in range(0, 400, 4)}


def test_noisy_or_gradient():
    """Against the product over sentences, and against finite differences."""
    import numpy as np

    rng = np.random.default_rng(1)
    doc_of, y, weight = np.array([0, 0, 0, 1, 2, 2, 3, 3]), np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.1, 0.2, 0.3, 0.4])
    z = rng.normal(size=8)
    p = 1 - np.array([np.prod(1 - 1 / (1 + np.exp(-z[doc_of == d]))) for d in range(4)])
    loss, gradient = toxicity.noisy_or(z, doc_of, y, weight)
    assert np.isclose(loss, -(weight * np.where(y > 0.5, np.log(p), np.log(1 - p))).sum())
    eye = np.eye(8) * 1e-6
    assert np.allclose(gradient, [(toxicity.noisy_or(z + e, doc_of, y, weight)[0] - toxicity.noisy_or(z - e, doc_of, y, weight)[0]) / 2e-6 for e in eye], atol=1e-6)
    model = toxicity.ToxicityModel(-1.0, {toxicity._features(b"moron")[0]: 3.0, toxicity._features(b"moro")[1]: 0.5})
    text = b"Nice. You moron! Moron, moron."
    logits = model.sentence_logits(text)
    assert np.allclose(logits, [-1, 2.5, 6])
    assert np.isclose(model.score([text])[0], 1 - np.prod(1 - 1 / (1 + np.exp(-logits))))


def test_regularised_leader_equals_plain_steps():
    import math

    import numpy as np

    r = random.Random(2)
    rows = [(r.choice("ab"), np.array(sorted(r.sample(range(12), 4))), np.full(4, 0.25)) for _ in range(20)]
    idf = np.linspace(1, 2, language_id.WIDTH)
    model = language_id.train(rows, idf)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f, k):
        if abs(z[f, k]) <= language_id.L1:
            return 0.0
        return -(z[f, k] - math.copysign(language_id.L1, z[f, k])) / ((language_id.BETA + math.sqrt(n[f, k])) / language_id.ALPHA + language_id.L2)

    learn, rng = [x for i, x in enumerate(rows) if i % 5 != 4], np.random.default_rng(7)
    for _ in range(language_id.EPOCHS):
        for i in rng.permutation(len(learn)):
            lang, grams, tf = learn[i]
            x = {**{int(g): language_id.SCALE * t * idf[g] for g, t in zip(grams, tf)}, "bias": 1.0}
            own = {(f, k): weight(f, k) for f in x for k in range(2)}
            logits = [sum(v * own[f, k] for f, v in x.items()) for k in range(2)]
            top = [math.exp(v - max(logits)) for v in logits]
            for k in range(2):
                error = top[k] / sum(top) - ("ab"[k] == lang)
                for f, v in x.items():
                    g = v * error
                    z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / language_id.ALPHA * own[f, k]
                    n[f, k] += g * g
    assert np.allclose(model.bias, [weight("bias", k) for k in range(2)])
    assert np.allclose(model.weights[:12], [[language_id.SCALE * idf[f] * weight(f, k) for k in range(2)] for f in range(12)], rtol=1e-5, atol=1e-6)
    assert not model.weights[12:].any()


def test_held_out_labels_do_not_train(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    docs = spark.createDataFrame([(i, "You utter moron!" if i % 4 == 0 else "You fine friend!") for i in range(60)], "doc_id bigint, text string").repartition(3)
    fits = [toxicity.fit(docs, spark.createDataFrame([(i, flip if held(i) else int(i % 4 == 0)) for i in range(60)], "doc_id bigint, toxic int").repartition(1 + flip), (3, 9)) for flip in (0, 1)]
    assert fits[0].weights and fits[0] == fits[1]
    again = toxicity.fit(docs.repartition(5), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(59, -1, -1)], "doc_id bigint, toxic int"), (3, 9))
    assert again == fits[0]


def test_forest_walk_equals_plain_walk(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    forest = quality.boost(x, (x[:, 0] + x[:, 3] ** 2 > 0.5).astype(float))

    def walk(row):
        out = forest.base
        for t in range(len(forest.feature) // forest.nodes):
            i = 0
            while not forest.leaf[t * forest.nodes + i]:
                k = t * forest.nodes + i
                i = 2 * i + 1 + (row[forest.feature[k]] > forest.threshold[k])
            out += forest.value[t * forest.nodes + i]
        return out

    assert np.allclose(forest.logits(x), [walk(r) for r in x])
    assert ((forest.logits(x) > 0) == (x[:, 0] + x[:, 3] ** 2 > 0.5)).mean() > 0.95


def test_splits_equal_plain_search():
    """Every split of the first trees has the greatest gain that trying all cuts of all features finds."""
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(300, 6)), 1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 4] > 0)).astype(float)
    forest = quality.boost(x, y)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(6)]
    score = lambda g, h: g.sum() ** 2 / (h.sum() + quality.RIDGE)
    f, splits = np.full(300, forest.base), 0
    for t in range(5):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        todo = [(0, np.arange(300))]
        while todo:
            i, rows = todo.pop()
            k = t * forest.nodes + i
            assert np.isclose(forest.value[k], -quality.RATE * g[rows].sum() / (h[rows].sum() + quality.RIDGE))
            gains = {}
            for j in range(6):
                for c in cuts[j]:
                    left, right = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                    if min(h[left].sum(), h[right].sum()) >= quality.LEAST_WEIGHT:
                        gains[j, c] = score(g[left], h[left]) + score(g[right], h[right]) - score(g[rows], h[rows])
            best = max(gains.values(), default=0)
            if forest.leaf[k]:
                assert i >= 2**quality.DEPTH - 1 or best <= 1e-6 + 1e-9
                f[rows] += forest.value[k]
                continue
            j, c = forest.feature[k], forest.threshold[k]
            assert np.isclose(gains[j, c], best)
            splits += 1
            todo += [(2 * i + 1, rows[x[rows, j] <= c]), (2 * i + 2, rows[x[rows, j] > c])]
    assert splits > 10


# licences


def test_license_base(spark, sf_dir):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    docs = documents(spark, sf_dir).unionByName(odd(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    expected = collections.Counter()
    for i, t in texts:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        hits = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in hits]
        expected[(i, len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))] += 1
    found = license_scan.scan_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == expected
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"), ("GNU General Public License v3 or later", "gpl,gpl-3.0-or-later"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("SPDX: LGPL-2.1-only", "lgpl-2.1-only"), ("all rights reserved", "proprietary"), ("an example", ""), ("MIT\nLICENSE", "mit"),
])
def test_license_rules(text, labels):
    assert license_scan.scan(text.encode())[5] == labels


@pytest.mark.parametrize(("text", "labels"), [
    ("This product includes software developed by the Apache\nSoftware Foundation", "apache-1.1"), ("includes: This product includes software developed by the OpenSSL Project", "openssl"),
    ("To the extent possible under law, X has waived all copyright", "cc0-1.0"), ("Do what the fuck you want to public license", "wtfpl"), ("Gemma Terms of Use", "gemma"),
    ("in the public\ndomain", "public-domain"), ("Creative\nCommons Zero", "cc0-1.0"), ("All advertising materials mentioning features or use of this software must display", "bsd-4-clause"),
])
def test_license_rules_without_other_words(text, labels):
    assert license_scan.scan(text.encode())[5] == labels


def test_license_long_text():
    """A long text of mentions takes time in proportion, and suppression equals comparing with all that was kept."""
    import time

    from tidemark.llm.license_rules import RULES

    r = random.Random(3)
    said = ["mit license", "licensed under the apache license, version 2.0", "gnu general public license v3", "cc by-nc 4.0", "all rights reserved", "or later", "bsd 3-clause", "lgpl-2.1-only", "word " * 9]
    low = " ".join(r.choice(said) for _ in range(150)).encode()
    plain = []
    for x in RULES:
        for b, e in (m.span() for m in x.pattern.finditer(low)):
            if not any(kb < e and b < ke and (kb <= b and e <= ke or e - b <= ke - kb) for kb, ke, _, _ in plain):
                plain.append((b, e, x.label, x.weight))
    assert license_scan.detections(low) == sorted(plain) and len(plain) > 100
    seconds = []
    for n in (2_000, 16_000):
        text = " ".join(r.choice(said) for _ in range(n)).encode()
        began = time.thread_time()
        assert license_scan.scan(text)[1] > n // 20
        seconds.append(time.thread_time() - began)
    assert seconds[1] < 20 * seconds[0]  # eight times the text


def written(parsed, r):
    """A text that a parsed expression matches, wrapped at some of its gaps."""
    from re import _parser as p

    out = b""
    for op, value in parsed:
        if op is p.LITERAL:
            out += bytes([value])
        elif op is p.ANY:
            out += b"\n"
        elif op is p.IN:
            kinds = [v for _, v in value]
            gap = p.CATEGORY_SPACE in kinds or (0, 0x2F) in kinds
            out += r.choice([b" ", b"\n"]) if gap else b"x" if value[0][0] is p.NEGATE else bytes([r.choice(kinds)])
        elif op in (p.MAX_REPEAT, p.MIN_REPEAT):
            out += b"".join(written(value[2], r) for _ in range(r.randint(value[0], min(value[1], value[0] + 1))))
        elif op is p.SUBPATTERN:
            out += written(value[-1], r)
        elif op is p.BRANCH:
            out += written(r.choice(value[1]), r)
    return out


def test_license_gate_loses_nothing():
    """Every rule matches the same with and without the gate, on texts made of its expression."""
    from re import _parser

    from tidemark.llm.license_rules import RULES

    r = random.Random(4)
    for rule in RULES:
        parsed = _parser.parse(rule.pattern.pattern, rule.pattern.flags)
        for _ in range(25):
            low = written(parsed, r)
            assert rule.pattern.search(low), (rule, low)
            ungated = []
            for x in RULES:
                for b, e in (m.span() for m in x.pattern.finditer(low)):
                    if not any(kb < e and b < ke and (kb <= b and e <= ke or e - b <= ke - kb) for kb, ke, _, _ in ungated):
                        ungated.append((b, e, x.label, x.weight))
            assert license_scan.detections(low) == sorted(ungated), (rule, low)


# chat format


def test_chat_round_trip(spark, sf_dir):
    turns = chat_format.with_control_case(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    odd_turns = [(90001, 0, "system", "<s>[INST]<\\s></s>[\\/INST]<<SYS>><\\\\/s> [[INST]"), (90001, 1, "assistant", None), (90001, 1, "assistant", "é</s>"), (90002, None, None, "<"), (None, 1, "assistant", "[/INST]")]
    turns = turns.unionByName(spark.createDataFrame(odd_turns, turns.schema)).repartition(7)
    by = collections.defaultdict(list)
    for r in turns.collect():
        by[r.conv_id].append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    expected = {}
    for c, rows in by.items():
        rows.sort()
        learnt = "".join(t for _, role, t in rows if role == "assistant")
        expected[c] = (len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    found = chat_format.digests(chat_format.format_conversations(turns)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == expected
    assert len(found) == len(expected) and -1 in expected


def test_chat_pieces_of_long_conversations(spark, monkeypatch):
    """Conversations of many pieces give what they give as one, next to short ones and null ids."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"[INST] turn {t} of {c} </s>" * (1 + t % 3)) for c in (1, 2, None, 5) for t in range(3 if c == 2 else 200)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    whole = chat_format.format_conversations(turns)
    assert whole.count() == 4
    expected = sorted(map(tuple, chat_format.digests(whole).collect()), key=str)
    monkeypatch.setattr(chat_format, "PIECE_BYTES", 2000)
    monkeypatch.setattr(chat_format, "SLICE_BYTES", 700)
    pieces = chat_format.format_conversations(turns)
    assert pieces.filter("piece > 2").count() > 0 and pieces.filter("piece = 0").count() == 4
    assert sorted(map(tuple, chat_format.digests(pieces).collect()), key=str) == expected


def test_chat_long_texts_and_clashing_columns(spark):
    """Long texts and many turns in one conversation, with columns of other meaning beside them."""
    long = "<s>é" * 700_000
    rows = [(1, 0, "user", long, 7, "x"), (1, 1, "assistant", long + "end", 7, "x"), (2, 0, "assistant", "", 7, "x")] + [(3, k, "assistant" if k % 2 else "user", f"t{k}" * (k % 50), 7, "x") for k in range(5000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns int, formatted string").repartition(3)
    found = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(turns)).collect()}
    learnt = "".join(r[3] for r in rows if r[0] == 3 and r[2] == "assistant")
    assert {k: v.n_turns for k, v in found.items()} == {1: 2, 2: 1, 3: 5000} and found[1].loss_chars == len(long) + 3
    assert found[3].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert found[1].turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n{long}end\n".encode()).hexdigest()


# benchmark decontamination


def test_search_equals_brute_force(spark, sf_dir):
    """WAND over blocks finds the items that full scoring of every passage finds."""
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index = decontamination.ItemIndex(items, threshold=0.4, question_share=0.0, answer_share=0.0)
    texts = [(r.text or "").encode() for r in documents(spark, sf_dir).limit(60).collect()]
    texts += [t + b" " + texts[k] for k, (_, t) in enumerate(items[:20])] + [b"", b"zzz"]
    found = {(d, number, h): score for d, number, h, score in index.search(texts)}
    names = {k: t for t, k in index.terms.items()}
    weight = [collections.Counter() for _ in index.items]
    for k, numbers in enumerate(index.numbers):
        for number, w in zip(numbers, index.weights[k]):
            weight[number][names[k]] = w
    expected = {}
    for d, text in enumerate(texts):
        words = decontamination.words_of(text)
        for h in range(-(-len(words) // index.half)):
            own = set(words[h * index.half : (h + 2) * index.half])
            for number, ws in enumerate(weight):
                if (score := sum(w for t, w in ws.items() if t in own)) >= 0.4:
                    expected[(d, number, h)] = score
    assert found.keys() == expected.keys() and len(found) > 20
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def test_contaminated_documents(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = benchmark.collect()
    docs = documents(spark, sf_dir)
    found = {r.doc_id for r in decontamination.contaminated(docs, decontamination.build_index(benchmark)).collect()}
    assert found == {r.doc_id for r in docs.collect() if any(i.text in (r.text or "") for i in items)}
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - found
    assert decontamination.contaminated(odd(spark), decontamination.build_index(benchmark)).count() == 0
    assert decontamination.contaminated(docs, decontamination.build_index(benchmark.limit(0))).count() == 0


def test_edited_items_are_found():
    """Items with a twentieth of their words replaced, planted in other words, are found nine times in ten and no others are."""
    rng = random.Random(1)
    words, weights = [f"w{i}" for i in range(3000)], [1 / (i + 5) for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, weights, k=40))) for i in range(300)]
    index = decontamination.ItemIndex([(i, t.encode()) for i, t in items])
    texts = []
    for _, text in items:
        own = text.split()
        for k in rng.sample(range(40), 2):
            own[k] = f"x{rng.randrange(9999)}"
        texts.append(" ".join([*rng.choices(words, weights, k=rng.randrange(20, 180)), *own, *rng.choices(words, weights, k=100)]).encode())
    found = {(d, index.items[n].item_id) for d, n, _, _ in index.search(texts)}
    assert all(d == i for d, i in found) and len(found) >= 270


def test_text_item_ids(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("item_id"), "text")
    docs = documents(spark, sf_dir)
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, decontamination.build_index(items)).collect()}
    plain = decontamination.contaminated(docs, decontamination.build_index(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).collect()
    assert found == {(r.doc_id, f"item-{r.item_id}") for r in plain} and found


def test_large_benchmark_is_searched_in_shards(spark, sf_dir):
    """Shards find what one index finds, with the scores of the whole benchmark."""
    benchmark, docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir)
    benchmark = benchmark.unionByName(spark.createDataFrame([(-1, "word " * 3000), (-2, "..."), (None, None)], benchmark.select("item_id", "text").schema), allowMissingColumns=True)
    whole, parts = (decontamination.build_index(benchmark, **size, threshold=0.5, question_share=0.3, answer_share=0.3) for size in ({}, {"shard_bytes": 1000}))
    assert len(whole.shards) == 1 and len(parts.shards) > 4
    sizes = [sum(len(x.text) for x in i.items) for i in parts.indexes()]
    assert sorted(sizes)[-2] <= 1000 and max(sizes) == 15000
    a, b = ({(r.doc_id, r.item_id): (r.passage, r.n_passages, round(r.score, 9)) for r in decontamination.contaminated(docs, x).collect()} for x in (whole, parts))
    assert a == b and len(a) >= 3


def test_index_grows_with_its_words():
    """Not with terms x blocks, nor a search with passages x blocks."""
    import pickle
    import tracemalloc

    r = random.Random(6)
    items = [(i, " ".join(f"t{r.randrange(60_000)}" for _ in range(12)).encode()) for i in range(6000)]
    index = decontamination.ItemIndex(items)
    assert len(pickle.dumps(index)) < 8_000_000
    texts = [" ".join(f"t{r.randrange(60_000)}" for _ in range(4000)).encode() for _ in range(50)] + [b"x " + items[7][1]]
    tracemalloc.start()
    found = index.search(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {index.items[n].item_id for d, n, _, _ in found if d == 50} == {7} and peak < 60_000_000


def test_stages_drop_by_id_and_text(spark):
    """Null and repeated ids: rows go by their own texts, and a null-id group keeps one document."""
    r = random.Random(8)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    item, a, b, c = some(20), some(60), some(60), some(60)
    leak = lambda: " ".join(some(10) + item + some(10))
    rows = [(None, leak()), (None, " ".join(a)), (None, " ".join([*a, "end"])), (None, " ".join([*a, "last"])), (1, leak()), (1, " ".join(some(50))), (2, " ".join(b)), (3, " ".join([*b, "x"])), (3, " ".join(some(40))), (None, " ".join([*b, "y"])), (None, None), (5, " ".join(c)), (5, " ".join([*c, "z"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = collections.Counter(map(tuple, ngram_join.drop_near_copies(docs).collect()))
    assert sum(kept[x] for x in rows[1:4]) == 1 and sum(kept[x] for x in rows[11:]) == 1
    assert set(kept) - {*rows[1:4], *rows[11:]} == {rows[i] for i in (0, 4, 5, 6, 8, 10)} and max(kept.values()) == 1
    benchmark = spark.createDataFrame([(None, " ".join(item)), (None, " ".join(some(30))), (4, " ".join(some(20)))], "item_id bigint, text string")
    kept = collections.Counter(map(tuple, decontamination.drop_contaminated(docs, benchmark).collect()))
    assert kept == collections.Counter(x for i, x in enumerate(rows) if i not in (0, 4))


# SentencePiece


def test_sentencepiece(spark, sf_dir):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        codec = Codec(f.read())
    r = random.Random(1)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(3, 32000)]
    texts = ["", " ", "   hello", "hello  world   ", " " * 40 + "x", "a\nb\n\n  c", "▁▁x ▁", "<s>[INST] </s> <0x0A> <unk>", "日本語 😀😀 ", "\0a", "aaaa aaaa" + "a" * 50, "$$$ %%%% &&&&&"]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 30))) for _ in range(1500)]
    texts += ["".join(r.choice("abcdefghetaoin  éàçñßü.,\n$$") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(0x80, 0x2FFF), r.randint(0x1F300, 0x1F6FF)])) for _ in range(r.randint(1, 20))) for _ in range(500)]
    for t in texts:
        ids = library.encode(t)
        assert codec.encode(t) == ids and codec.decode(ids) == library.decode(ids), t
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    expected = collections.Counter()
    for row in docs.collect():
        ids = library.encode(row.text or "")
        expected[(row.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, digest_documents(docs, path).collect())) == expected
    sample = docs.limit(20)
    assert {r.doc_id: list(r.ids) for r in encode_documents(sample, path).collect()} == {r.doc_id: library.encode(r.text or "") for r in sample.collect()}
    stray = [library.piece_to_id(p) for p in ("<0xC3>", "▁a", "<0xE2>", "<0x82>", "<0xAC>", "<0xFF>", "<0xA9>")] + [0, 1, 2]
    assert codec.decode(stray) == library.decode(stray)


def test_sentencepiece_codes_short_words_whole(monkeypatch):
    """Only longer words are looked through for seams, and few answers of pair tests are held at once; ids stay the same."""
    import sentencepiece

    from tidemark.llm import sentencepiece_codec as module

    path = tokenizer_path("piece_bpe_32k.model")
    library, looked, seams = sentencepiece.SentencePieceProcessor(model_file=path), [], module.PieceModel.seams
    monkeypatch.setattr(module.PieceModel, "seams", lambda self, text: looked.append(len(text)) or seams(self, text))
    monkeypatch.setattr(module, "PAIRS", 50)
    with open(path, "rb") as f:
        codec = Codec(f.read())
    r = random.Random(2)
    texts = [" ".join("".join(r.choice(("th", "hn", "qx", "wh", "ü", "e", "on", "日", "Ā", "\x01")) for _ in range(r.randint(1, 20))) for _ in range(8)) for _ in range(300)]
    for t in texts:
        ids = library.encode(t)
        assert codec.encode(t) == ids and codec.decode(ids) == library.decode(ids), t
        assert codec.model.tested <= 50 and sum(len(f) for _, _, f in codec.model.automaton.values()) == codec.model.tested
        if len(looked) > 20:
            break
    assert looked and min(looked) > 24


# empty tables


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, tmp_path, name):
    for t, schema in {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string", "conversations": "conv_id bigint, turn bigint, role string, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries()[name](spark, str(tmp_path)).count() == (name == "op5_chat_format")


def test_arrow_batches_are_bounded_by_bytes(spark):
    rows = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 100000)").alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    found = [r.n for r in map_batches(rows, sizes, "n bigint").collect()]
    assert sum(found) > 20_000_000 and max(found) < 5_000_000


def test_sentencepiece_words_of_a_column_are_remembered_as_arrays(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "MEMORY", 20)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    long = "long" * 40
    for k in range(12):
        texts = [f"the word {k} and n{k}x {long} \u2603{k} the", None, "", f" two  spaces {k}", "\U0001f980 \x00 a\u2581b", *(f"w{k}q{i}" for i in range(15))]
        counts, ids, decoded = codec.columns(pa.array(texts, pa.string()))
        for t, n, i, d in zip(texts, counts.to_pylist(), ids.to_pylist(), decoded.to_pylist(), strict=True):
            own = library.encode(t or "")
            assert (n, i, d) == (len(own), ",".join(map(str, own)), library.decode(own)), t
        assert len(codec.known[0]) <= 3 * 20 + len(texts) and long not in codec.known[0].to_pylist()
        assert "the" in codec.known[0].to_pylist()
    codec.forget()
    assert not len(codec.known[0])


def test_sentencepiece_dropped_tables_are_freed():
    import gc
    import weakref

    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        codec = Codec(f.read())
    codec.encode("words that follow each other")
    model = weakref.ref(codec.model)
    del codec
    gc.collect()
    assert model() is None


def test_sentencepiece_tasks_of_a_worker_share_their_tables(spark):
    docs = spark.range(0, 16, 1, 16).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    assert encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).select("n_tokens").distinct().count() == 1

    def held(batches):
        from tidemark.llm import sentencepiece_codec as module

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(module._codecs)] * batch.num_rows)], names=["n"])

    # The tasks above went round the workers that these get again.
    assert max(r.n for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n bigint").collect()) == 1
