import collections
import itertools
import random
import re

import numpy as np
import pytest

from sensorline.llm import bagminhash as bag
from sensorline.llm import graph, itq


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else None


def brute_classes(texts, least=0.8):
    sets = {k: shingles(t) for k, t in texts.items()}
    top = {k: k for k in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b]:
            low, high = sorted((sum(sets[a].values()), sum(sets[b].values())))
            if low >= least * high and sum((sets[a] & sets[b]).values()) >= least * sum((sets[a] | sets[b]).values()):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = np.random.default_rng(0)
    for a, b in (({1: 1, 2: 5, 3: 2, 9: 1}, {1: 1, 2: 6, 3: 1, 7: 2}), ({i: 1 + i % 4 for i in range(50)}, {i: 1 + i % 5 for i in range(10, 60)})):
        both = {*a, *b}
        want = sum(min(a.get(k, 0), b.get(k, 0)) for k in both) / sum(max(a.get(k, 0), b.get(k, 0)) for k in both)
        owner = np.repeat([0, 1], [len(a), len(b)])
        hits = []
        for _ in range(200):
            salt = int(rng.integers(1 << 60))
            keys = bag._mix(np.array([k * 7919 + salt for k in [*a, *b]], np.uint64))
            s = bag.bag_signatures(owner, keys, np.array([*a.values(), *b.values()]), 2, 64)
            hits.append((s[0] == s[1]).mean())
        assert np.mean(hits) == pytest.approx(want, abs=4 * np.std(hits) / 200**0.5)


def test_words_that_fool_sums_over_places_do_not_link(spark):
    """Thue-Morse words: sums of their letters times powers of an odd number are equal modulo 2**64."""
    one = "a"
    while len(one) < 4096:
        one += "".join("b" if c == "a" else "a" for c in one)
    other = "".join("b" if c == "a" else "a" for c in one)
    pairs = [(one[:n], other[:n]) for n in (64, 100, 1024, 4096)]
    assert bag.overlaps([a for a, _ in pairs], [b for _, b in pairs]).max() == 0
    df = spark.createDataFrame(list(enumerate(t for pair in pairs for t in pair)), "doc_id long, text string")
    assert all(r.kept for r in bag.near_duplicates(df).collect())


def near_texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    texts = {}
    for g in range(6):  # originals in the middle of their copies' ids, copies far from each other
        base = rng.choices(words, k=150)
        for c in range(40):
            copy = list(base)
            for _ in range(0 if c == 20 else 1 + c % 4):
                copy[rng.randrange(150)] = rng.choice(words)
            texts[g * 100 + c] = " ".join(copy)
    for k in range(40):
        texts[1000 + k] = " ".join(rng.choices(words, k=60))
    return texts | {2000: "", 2001: " \n", 2002: "one two", 2003: "one two", 2004: "one  two", 2005: None}


def test_classes_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = near_texts() | {10_000 + r.doc_id: r.text for r in docs.collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in bag.near_duplicates(df).collect()}
    assert got == brute_classes(texts)


def test_full_bands_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bag, "BLOCK", 8)
    monkeypatch.setattr(bag, "TASK_ROWS", 20)
    texts = {k: t for k, t in near_texts().items() if k < 300}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bag.near_duplicates(df).collect()} == brute_classes(texts)


def test_repeated_and_null_ids(spark):
    long = " ".join(f"a{k}" for k in range(50))
    df = spark.createDataFrame([(5, long, 1), (5, long, 1), (3, long, 2), (None, long, 3), (8, "other text of six words here", 4)], "doc_id long, text string, Bands int")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in bag.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, None, True), (8, 8, True)], key=str)
    stay = bag.keep_one(df)
    assert stay.columns == df.columns and sorted(r.Bands for r in stay.collect()) == [2, 3, 4]
    assert bag.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(1000, 1050)] + [(3, 3), (9, None)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 7 for k in range(1000, 1050)) and 3 not in got


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(30):
        base = rng.standard_normal(64)
        for _ in range(1 + g % 12):
            rows.append((len(rows), [float(x) for x in base + 0.1 * rng.standard_normal(64)], g % 3))
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], rows[0][2]), (902, [2 * x for x in rows[0][1]], rows[0][2]), (903, rows[0][1], 2), (904, rows[0][1], None)]
    rows += [(905, None, 1), (906, [0.0] * 64, 1), (907, [float("nan")] * 64, 1), (908, [1.0, 2.0], 1), (909, [2.0, 4.0], 1), (910, [], 1), (None, rows[0][1], rows[0][2]), (911, [None, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in itq.near_duplicates(df.filter("vec_id is not null")).collect()}
    real = [(i, np.float32(v).astype(float), l) for i, v, l in rows if i is not None and v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    want = collections.Counter()
    for (i, v, l), (j, w, m) in itertools.combinations(real, 2):
        if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
            want[i] += 1
            want[j] += 1
    found = sum(r.n_links for r in got.values())
    assert found >= 0.97 * sum(want.values()) and all(r.n_links <= want[k] for k, r in got.items())
    assert got[900].component_id == got[901].component_id == got[902].component_id == got[0].component_id
    assert all(got[k].n_links == 0 and got[k].kept for k in (904, 905, 906, 907, 910, 911)) and got[908].n_links == 1
    assert itq.near_duplicates(df).filter("vec_id is null and n_links = 0 and kept").count() == 1
    assert itq.near_duplicates(df.limit(0)).count() == 0


def test_full_buckets_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 7)
    rng = np.random.default_rng(8)
    base = rng.standard_normal(32)
    rows = [(k, [float(x) for x in base + 0.02 * rng.standard_normal(32)], 1) for k in range(60)]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert all(r.n_links == 59 and r.component_id == 0 for r in got)


def test_vectors_about_a_distant_mean(spark):
    """Signs about the origin are not balanced there; planted neighbours must still be found, at a fraction of all pairs."""
    rng = np.random.default_rng(11)
    n, dim = 4000, 32
    x = rng.standard_normal((n, dim))
    mean = rng.standard_normal(dim)
    x += 3 * np.sqrt(dim) * mean / np.linalg.norm(mean)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = rng.uniform(0.985, 0.999, 200)
    side = rng.standard_normal((200, dim))
    side -= (side * unit[:200]).sum(1, keepdims=True) * unit[:200]
    x[1000:1200] = want[:, None] * unit[:200] + np.sqrt(1 - want[:, None] ** 2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = int((np.triu(unit @ unit.T, 1) >= 0.98).sum())
    df = spark.createDataFrame([(k, [float(z) for z in v], 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    given = itq.clean_vectors(df).select(itq.F.col("vec_id").alias("node"), itq.F.lit(1).cast("long").alias("copies"), "label", "v")
    keys = np.array([r["keys"] for r in itq.split_keys(itq.index(given)).select("keys").collect()])
    pairs = sum(int(c * (c - 1) // 2) for k in range(itq.TABLES) for c in np.unique(keys[:, k], return_counts=True)[1])
    assert pairs < 0.05 * n * n
    got = itq.near_duplicates(df).collect()
    assert true >= 200 and 0.9 * true <= sum(r.n_links for r in got) / 2 <= true


def test_given_documents_link_as_by_brute_force(spark, sf):
    """All pairs of the given table: near copies of an overlap of 0.8 or more are one class, the others stay apart."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    first = {}
    for k in sorted(texts):
        first.setdefault(texts[k], k)
    classes = brute_classes({k: t for t, k in first.items()})
    got = {r.doc_id: r.class_id for r in bag.near_duplicates(docs).collect()}
    assert got == {k: classes[first[t]] if shingles(t) else k for k, t in texts.items()}
    assert len(set(got.values())) < len(set(texts.values()))
