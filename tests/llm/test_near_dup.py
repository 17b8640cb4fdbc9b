"""Operator 7: against brute force over all pairs, and its parts."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracefold.llm import components as C
from tracefold.llm import near_dup as N

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    w = text.encode().lower().split() if text else []
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows, percent=85):
    """doc_id -> smallest id reachable, over all pairs of documents."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                t = len(sets[a] & sets[b])
                if 100 * t >= percent * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("key", F.lit(1))
    got = N.near_duplicates(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_random_edits_against_all_pairs(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, (" " if rng.random() < 0.8 else "\n\t ").join(w).upper() if rng.random() < 0.3 else " ".join(w)))
            i += 1
    rng.shuffle(rows)
    check(spark, rows)


def test_large_group_of_near_copies_and_shared_passage(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(120)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(150):                # copies of one text, pairwise at any similarity from 0.3 to 1
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    for i in range(150, 250):           # a passage that many share, in texts that are otherwise apart
        rows.append((i, " ".join(passage + [rng.choice(vocab) for _ in range(rng.randrange(5, 40))])))
    rows += [(i, rows[i % 7][1]) for i in range(250, 330)]      # exact copies
    check(spark, rows)


def test_large_classes_are_split(spark):
    rows = [(i, "the same six words in all") for i in range(40, 90)] + [(i, None) for i in range(20)] + [(i, f"own words of number {i} only") for i in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.near_duplicates(docs, class_rows=8).collect()
    want = brute(rows)
    assert len(got) == len(rows) and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "x " * 20_000), (8, "x " * 9), (9, "a b"), (9, "a b"), (None, "a b"), (None, None), (0, "é É"), (10, "é É")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).count() == 0


def test_a_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(spark, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def plain_superminhash(elements, places, seed):
    """One shingle after another, with the permutation in full."""
    sig = [N._EMPTY] * places
    for e in elements:
        p = list(range(places))
        for j in range(places):
            r = int(N.mix(np.array([e], np.uint64) ^ N.mix(np.array([seed + j], np.uint64)))[0])
            k = j + ((r >> 32) * (places - j) >> 32)
            p[j], p[k] = p[k], p[j]
            sig[p[j]] = min(sig[p[j]], (j << 32) | (r & 0xFFFFFFFF))
    return [int(x) for x in sig]


def test_signature_equals_the_plain_one():
    rng = np.random.default_rng(1)
    for places in (1, 7, 24, 40):
        sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 3, 5, 9, 20, 100, 300)]
        got = N.superminhash(sets, places, 3)
        for s, g in zip(sets, got, strict=True):
            assert g.tolist() == plain_superminhash(s.tolist(), places, 3)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])        # 300 / 500
    same = np.mean([(lambda s: (s[0] == s[1]).mean())(N.superminhash([a, b], 192, seed)) for seed in range(0, 40_000, 1000)])
    assert abs(same - 0.6) < 0.02


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(100, 400)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (7, 6), (6, 7), (7, 6), (None, 3), (3, None)]
    links += [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(200)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in links:
        if u is not None and v is not None:
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "u long, v long").repartition(5)
    got = {r["node"]: r["component"] for r in C.components(df).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert C.components(df.limit(0)).count() == 0
