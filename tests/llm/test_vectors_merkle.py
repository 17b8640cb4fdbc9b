import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import merkle, neighbours, queries, whitening

SF = "/root/testdata/sf0.001"
VECS = "vec_id long, embedding array<float>"


# --------------------------------------------------------------------------- operator 11
def brute_whiten(rows, most=16):
    """Rows (id, vector of finite numbers): n, deviations, whitened (up to sign), explained."""
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ axes / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening_against_brute_force(spark):
    out = queries.op11_embedding_whitening(spark, SF).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, whitened, explained = brute_whiten(rows)
    by = {(r["vec_id"], r["component"]): r for r in out}
    assert len(out) == len(by) == 16 * len(rows) and {r["n"] for r in out} == {n}
    got = np.array([[by[i, k]["whitened"] for k in range(1, 17)] for i, _ in rows])
    sign = np.sign((got * whitened).sum(0))
    assert np.abs(got - sign * whitened).max() < 1e-9
    assert all(by[i, 1]["deviation"] == d for (i, _), d in zip(rows, deviation, strict=True))
    assert np.allclose([by[rows[0][0], k]["explained"] for k in range(1, 17)], explained, rtol=1e-10)
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-10


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (7, 3), (12, 12), (33, 20)])
def test_pivoted_cholesky_and_jacobi(d, rank):
    b = np.random.default_rng(d).normal(size=(d, rank)) * np.geomspace(1, 1e-4, rank)
    a = b @ b.T
    order, low = whitening.pivoted_cholesky(a)
    assert low.shape == (d, rank) and np.allclose(low @ low.T, a[np.ix_(order, order)], atol=1e-14 * a.max())
    assert np.allclose(low, np.tril(low))
    values, axes = whitening.principal_axes(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-7, atol=0)
    assert np.allclose(axes @ axes.T, np.eye(rank), atol=1e-12) and np.allclose(axes @ a @ axes.T, np.diag(values), atol=1e-13 * a.max())


def test_tournament_meets_every_pair_once():
    for m in range(1, 9):
        met = [(min(a, b), max(a, b)) for p, q in whitening._tournament(m) for a, b in zip(p.tolist(), q.tolist(), strict=True)]
        assert sorted(met) == [(a, b) for a in range(m) for b in range(a + 1, m)]


def test_whitening_odd_rows(spark):
    rnd = np.random.default_rng(5)
    good = [(i, rnd.normal(size=3).tolist()) for i in range(40)] + [(3, [0.5, 0.25, 1.0]), (None, [1.0, 2.0, 3.0])]
    good += [(50, good[0][1]), (50, good[0][1])]             # equal vectors count once in the fit
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, math.nan, 2.0]), (94, [math.inf, 0.0, 0.0]), (95, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, VECS).withColumn("component", F.lit("x")).withColumn("n", F.lit(None))
    out = whitening.whiten(df).collect()
    n, deviation, whitened, _ = brute_whiten(good)
    assert n == 42 and len(out) == 3 * len(good) and {r["vec_id"] for r in out} == {i for i, _ in good}
    none = {r["component"]: r for r in out if r["vec_id"] is None}
    assert np.allclose([abs(none[k]["whitened"]) for k in (1, 2, 3)], np.abs(whitened[41]))
    assert none[1]["deviation"] == deviation[41] and out[0]["identity_error"] < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, VECS)).collect() == []


def test_whitening_of_far_entries_and_low_rank(spark):
    rows = [(i, [float(i % 3) * 1e12, -1e30 if i == 4 else 1.0, 2.0 * (i % 3)]) for i in range(9)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert out and all(math.isfinite(r["whitened"]) for r in out) and out[0]["identity_error"] < 1e-4
    assert all(r["deviation"] is None for r in out)         # beyond a long


# --------------------------------------------------------------------------- operator 12
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_merkle(rows, fields, change):
    """{(key, leaf): result} with whole trees in memory; rows are dicts with doc_id and lang."""
    def leaf(r):
        return h(*["-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in fields])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, i):
        for below in tree[:-1]:
            yield ("L", below[i - 1]) if i % 2 else ("R", below[i + 1]) if i + 1 < len(below) else ("=", "")
            i //= 2

    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: b"" if g is None else b"+" + g.encode())
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = {}
    for at, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = [*path(trees[g], i), *path(top, at)]
            folded = leaf({**r, **change(r)})
            for side, other in steps:
                folded = h(other, folded) if side == "L" else h(folded, other)
            out[r["doc_id"], leaf(r)] = (trees[g][-1][0], top[-1][0], h(*[o for _, o in steps]), folded, folded == top[-1][0])
    return out


def add_one(r):
    hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
    return {"n_chars": r["n_chars"] + 1} if hit else {}


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))


def results(df):
    return {(r["key"], r["leaf"]): (r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect()}


def test_manifest_against_brute_force(spark):
    out = queries.op12_merkle_manifest(spark, SF)
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_merkle(rows, FIELDS, add_one)
    assert results(out.withColumnRenamed("doc_id", "key")) == want and out.count() == len(rows)
    assert {v[-1] for v in want.values()} == {True, False}


@pytest.mark.parametrize("levels", [1, 3, 11])
def test_blocks_of_any_height_give_the_same_tree(spark, levels):
    """Trees of 1 to 40 leaves, cut into slabs of few levels, nulls in every column, repeated rows, clashing names."""
    rnd = np.random.default_rng(levels)
    rows = [(int(i), "t" * int(rnd.integers(0, 4)) + "é", f"l{g}", "s", int(i), "x") for g, size in enumerate((1, 2, 3, 5, 8, 17, 40)) for i in rnd.permutation(size)]
    rows += [(None, None, None, None, None, None), (1, "", None, "s", 0, ""), (7, "same", "", "s", 1, "y"), (7, "same", "", "s", 1, "y"), (7, "other", "", "s", 1, "y")]
    rows += [(9, "long " * 100_000, "l1", "s", 2, "z")]
    out = merkle.verify(spark.createDataFrame(rows, DOCS), FIELDS, "lang", "doc_id", {"n_chars": tampered()}, levels)
    names = [f.split()[0] for f in DOCS.split(", ")]
    want = brute_merkle([dict(zip(names, r, strict=True)) for r in rows], FIELDS, add_one)
    # repeated rows have one leaf digest and different proofs
    same = h(*[f"{len(str(v).encode())}:{v}" for v in (7, "s", "", 1, "same")])
    got = out.collect()
    assert len(got) == len(rows) and len({r["proof_sha256"] for r in got if r["leaf"] == same}) == 2
    assert {k: v for k, v in results(out).items() if k[1] != same} == {k: v for k, v in want.items() if k[1] != same}


def test_proofs_can_be_given_away(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "de", "s", i, "") for i in range(30)]
    manifest = merkle.build(spark.createDataFrame(rows, DOCS), FIELDS, "lang", "doc_id")
    for r in merkle.proofs(manifest).collect():
        assert merkle.fold(r["digest"], r["proof"]) == manifest.root
        assert merkle.fold(h("other"), r["proof"]) != manifest.root


def test_empty_manifest(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.verify(empty, FIELDS, "lang", "doc_id", {}).collect() == []
    assert merkle.proofs(merkle.build(empty, FIELDS, "lang", "doc_id")).collect() == []


# --------------------------------------------------------------------------- operator 13
def brute_nearest(rows, is_query, most):
    """{(query id, vector): [(id, score)]}; rows are distinct (id, vector)."""
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, (q, v) in enumerate(rows):
        if is_query(q):
            s = x @ x[i]
            ranks = sorted((-s[j], rows[j][0]) for j in range(len(rows)) if j != i)[:most]
            out[q, tuple(v)] = [(b, -a) for a, b in ranks]
    return out


def recall(out, want, keys):
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append(r)
    shares = []
    for q, ranks in keys.items():
        mine = sorted(got.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(want[ranks]) + 1))
        assert all(a["score"] >= b["score"] for a, b in zip(mine, mine[1:]))
        # the k-th score found against the k-th best: ties count as found
        shares.append(np.mean([abs(r["score"] - s) < 1e-9 or r["vec_id"] in {i for i, _ in want[ranks]} for r, (_, s) in zip(mine, want[ranks], strict=True)]))
    return float(np.mean(shares))


def test_nearest_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    out = queries.op13_nearest_neighbours(spark, SF).collect()
    assert len(out) == 20 * len(want)
    assert recall(out, want, {k[0]: k for k in want}) >= 0.95


def test_recall_of_a_larger_graph(spark):
    """Small chunks, blocks and lists, so that the descent and the walk do the work: 3,000 points of 16 dimensions, of unequal lengths."""
    rnd = np.random.default_rng(8)
    rows = [(i, (rnd.normal(size=16) * rnd.uniform(0.2, 2)).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, VECS)
    out = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, chunk=64, block=256, orders=2).collect()
    want = brute_nearest(rows, lambda i: i % 20 == 0, 20)
    assert recall(out, want, {k[0]: k for k in want}) >= 0.9


def test_descent_improves_the_lists(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(1500, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = neighbours.vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], VECS), chunk=64, block=256, orders=3)
    at = {r["key"]: np.frombuffer(r["vec"], "<f4") for r in v.nodes.collect()}
    m = np.array([at[k] for k in range(1500)])
    s = m @ m.T
    np.fill_diagonal(s, -9)
    true = np.argsort(-s, axis=1)[:, :10]

    def share(graph):
        lists = {r["key"]: np.frombuffer(r["ids"], "<u4") for r in graph.collect()}
        assert len(lists) == 1500 and all(k not in lists[k] and len(set(lists[k])) == len(lists[k]) == neighbours.LINKS for k in lists)
        return np.mean([len(set(true[k]) & set(lists[k])) / 10 for k in lists])

    first, last = share(neighbours.descend(v, most_rounds=0)), share(neighbours.descend(v))
    assert first < 0.6 and last > 0.9


def test_copies_ties_and_odd_rows(spark):
    """Many copies of one vector: the smallest ids come first; odd rows take no part; extra columns with clashing names."""
    hot = [0.6, 0.8, 0.0]
    rows = [(i, hot) for i in range(100, 400)] + [(i, [float(i), 1.0, 0.5]) for i in range(10)] + [(20, hot), (20, hot)]
    bad = [(40, None), (60, []), (80, [0.0, 0.0, 0.0]), (500, [1.0, None, 0.0]), (520, [math.nan, 0.0, 0.0]), (540, [1.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + bad, VECS).withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).withColumn("node", F.lit(None))
    out = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    distinct = sorted({(i, tuple(np.array(v, np.float32).astype(float))) for i, v in rows})
    want = brute_nearest(distinct, lambda i: i % 20 == 0, 20)
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    assert got == {k[0]: [(i, round(s, 9)) for i, s in v] for k, v in want.items()}


def test_an_id_with_two_vectors_and_few_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])]
    out = neighbours.nearest(spark.createDataFrame(rows, VECS), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == [(20, 1, 3, 1.0), (20, 1, 3, 1.0), (20, 2, 20, 0.0), (20, 2, 20, 0.0)]


@pytest.mark.parametrize("rows", [[], [(20, None)], [(20, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [2.0, 1.0])]])
def test_no_neighbours(spark, rows):
    assert neighbours.nearest(spark.createDataFrame(rows, VECS), F.col("vec_id") % 20 == 0, 20).collect() == []


def test_best_keeps_the_first_of_equal_ids():
    g, i, s = np.array([1, 0, 1, 1, 0]), np.array([5, 2, 5, 4, 3]), np.array([0.5, 0.1, 0.5, 0.5, 0.9])
    assert neighbours.best(g, i, s, 1).tolist() == [4, 3]
    assert neighbours.best(g, i, s, 9).tolist() == [4, 1, 3, 0]


def test_tasks_follow_the_nodes_not_the_shuffle_partitions(spark):
    """Many shuffle partitions don't start as many Python tasks for a few nodes; many nodes use them all."""
    from tracefold.llm import neighbours
    rows = spark.range(500).withColumnRenamed("id", "key")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        few, many = neighbours.dealt(rows, 500, "key"), neighbours.dealt(rows, 2_000_000, "key")
        assert few.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism < 61 == many.rdd.getNumPartitions()
        assert sorted(r.key for r in few.collect()) == list(range(500))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
