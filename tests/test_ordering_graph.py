import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracefold.operators import graph, ordering


def test_sequence_within_matches_window(spark):
    rnd = random.Random(7)
    rows = [(k, t) for k in range(5) for t in rnd.sample(range(0, 3000), 200)] + [(99, 5)]
    df = spark.createDataFrame(rows, "k long, t long")
    got = ordering.sequence_within(df, ["k"], "t", bucket_width=64).select("k", "t", "seq", "prev", "next")
    w = Window.partitionBy("k").orderBy("t")
    exp = df.select("k", "t", F.row_number().over(w).cast("bigint").alias("seq"), F.lag("t").over(w).alias("prev"),
                    F.lead("t").over(w).alias("next"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_top_k_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, float(rnd.randint(0, 50))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = ordering.top_k(df, ["g"], [F.col("v").desc(), F.col("id").asc()], 5, "id", buckets=8)
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id").asc())
    exp = df.withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 5")
    assert sorted(got.collect()) == sorted(exp.collect())


def test_dedupe_first(spark):
    df = spark.createDataFrame([(1, 1, 5, "late"), (1, 1, 2, "early"), (1, 2, 9, "only")], "d long, e long, at long, p string")
    out = {(r.d, r.e): r for r in ordering.dedupe_first(df, ["d", "e"], ["at"], "n").collect()}
    assert out[(1, 1)].p == "early" and out[(1, 1)].n == 2 and out[(1, 2)].n == 1


def test_walk_matches_brute_force(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "e"), ("x", "y")]
    e = spark.createDataFrame([("next_step", "Step", f, "Step", t, None) for f, t in edges],
                              "edge_type string, from_type string, from_id string, to_type string, to_id string, ts timestamp_ntz")
    seeds = spark.createDataFrame([("Step", "a"), ("Step", "x")], "seed_type string, seed_id string")
    got = {(r.seed_id, r.node_id, r.hops) for r in graph.walk(e, seeds, 2).collect()}
    assert got == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("x", "y", 1)}


EDGES = "edge_type string, from_type string, from_id string, to_type string, to_id string, ts timestamp_ntz"


def test_walk_through_a_planted_hub(spark):
    """A third of all edges leave one node that all seeds reach; cells stay near the limit, no pair is lost."""
    rnd = random.Random(5)
    pairs = [(f"s{i}", "hub") for i in range(300)] + [("hub", f"h{i}") for i in range(900)] + [("hub", "h1")] * 50
    pairs += [(f"h{rnd.randrange(900)}", f"z{rnd.randrange(400)}") for _ in range(1200)]
    e = spark.createDataFrame([("next_step", "Step", f, "Step", t, None) for f, t in pairs] + [("next_step", "Step", None, "Step", "x", None)], EDGES)
    seeds = spark.createDataFrame([("Step", f"s{i}") for i in range(300)] * 2, "seed_type string, seed_id string")
    got = graph.walk(e, seeds, 3, hub_rows=64).collect()
    onward = {}
    for f, t in set(pairs):
        onward.setdefault(f, set()).add(t)
    second = onward["hub"]
    third = set().union(*[onward.get(h, set()) for h in second]) - second
    exp = {(f"s{i}", n, d) for i in range(300) for d, ns in ((1, {"hub"}), (2, second), (3, third)) for n in ns}
    assert len(got) == len(exp) and {(r.seed_id, r.node_id, r.hops) for r in got} == exp
    # the cells of the second hop: about 64 rows a side, each pair of parts there
    frontier = seeds.distinct().withColumns({"node_type": F.lit("Step"), "node_id": F.lit("hub")})
    once = e.select("from_type", "from_id", "to_type", "to_id").dropna().distinct()
    hubs = graph.hub_parts(once, "from_type", "from_id", 64, "edge_parts").join(
        graph.hub_parts(frontier, "node_type", "node_id", 64, "seed_parts"), ["node_type", "node_id"], "full")
    f, g = graph.split_hubs(frontier, once, hubs)
    cells_f = [r["count"] for r in f.groupBy("node_id", "seed_part", "edge_part").count().collect()]
    cells_g = [r["count"] for r in g.filter("from_id = 'hub'").groupBy("seed_part", "edge_part").count().collect()]
    assert len(cells_f) == len(cells_g) == 5 * 15 and max(cells_f) <= 2 * 64 and max(cells_g) <= 2 * 64
    rest = g.filter("from_id <> 'hub'")
    assert rest.count() == once.filter("from_id <> 'hub'").count() and rest.filter("seed_part + edge_part > 0").isEmpty()


def test_walk_with_many_hubs_and_with_nothing(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_BROADCAST_ROWS", 0)     # hubs joined like any table
    pairs = [(f"n{i}", f"n{(i * 7 + j) % 40}") for i in range(40) for j in range(6)]
    e = spark.createDataFrame([("next_step", "Step", f, "Step", t, None) for f, t in pairs], EDGES)
    seeds = spark.createDataFrame([("Step", f"n{i}") for i in range(40)], "seed_type string, seed_id string")
    key = lambda df: sorted((r.seed_id, r.node_id, r.hops) for r in df.collect())
    assert key(graph.walk(e, seeds, 2, hub_rows=2)) == key(graph.walk(e, seeds, 2))
    assert graph.walk(e.limit(0), seeds, 2).isEmpty() and graph.walk(e, seeds.limit(0), 2).isEmpty()


def test_similarity_top_k_matches_brute_force(spark):
    rnd = random.Random(11)
    vecs = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    qs = [(q, [rnd.uniform(-1, 1) for _ in range(8)]) for q in range(3)]
    v = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    q = spark.createDataFrame(qs, "query_id long, query_vec array<double>")
    got = graph.similarity_top_k(v, q, 4, blocks=2, buckets=4).select("query_id", "vec_id", "rank").collect()

    import math
    vrows = [(r.vec_id, list(r.embedding)) for r in v.collect()]
    exp = set()
    for qid, qv in qs:
        def cos(x):
            return round(sum(a * b for a, b in zip(qv, x)) / (math.sqrt(sum(a * a for a in qv)) * math.sqrt(sum(b * b for b in x))), 6)
        ranked = sorted(vrows, key=lambda r: (-cos(r[1]), r[0]))[:4]
        exp |= {(qid, vid, i + 1) for i, (vid, _) in enumerate(ranked)}
    assert {(r.query_id, r.vec_id, r.rank) for r in got} == exp


def test_similarity_blocks_follow_the_queries(spark):
    rnd = random.Random(12)
    v = spark.createDataFrame([(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(50)] + [(99, [0.0] * 4), (98, None)], "vec_id long, embedding array<float>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    key = lambda df: sorted((r.query_id, r.rank, r.vec_id, r.similarity) for r in df.collect())
    one, many = key(graph.similarity_top_k(v, q, 3)), key(graph.similarity_top_k(v, q, 3, blocks=7))
    assert one == many and len(one) == 150 and all(r[3] == 1.0 for r in one if r[1] == 1)


def test_lsh_recall_against_the_exact_path(spark):
    """All vectors of sf0.1, every tenth a query: random directions, the hardest case for hashing."""
    from tracefold.plans import q_graph
    sf = "/root/testdata/sf0.1"
    v, q = q_graph.every_tenth(spark, sf)
    exact = graph.similarity_top_k(v, q, q_graph.SIM_K, buckets=8).cache()
    found = q_graph.jn13_similarity_lsh(spark, sf)
    got = graph.search_recall(found, exact).first()
    assert got.queries == 200 and got.results == 1000 and got.recall >= 0.9, got
    # what both have is the same to the last digit
    both = found.join(exact.select("query_id", "vec_id", F.col("similarity").alias("s")), ["query_id", "vec_id"])
    assert both.count() > 900 and both.filter("similarity <> s").isEmpty()


def test_lsh_looks_at_a_part_of_a_large_set(spark):
    """6,000 vectors around 60 centres: recall holds while few pairs are compared."""
    import numpy as np
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(60, 16))
    x = (np.repeat(centres, 100, axis=0) + 0.15 * rnd.normal(size=(6000, 16))).astype("float32")
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    index = graph.HyperplaneIndex(dim=16, tables=8, bits=8, probes=2)
    exact = graph.similarity_top_k(v, q, 10, buckets=8)
    assert graph.search_recall(graph.similarity_lsh(v, q, 10, index), exact).first().recall >= 0.9
    have, ask = graph.lsh_buckets(v, index, "vec_id", "embedding"), graph.lsh_buckets(q, index, "query_id", "query_vec", probe=True)
    assert have.count() == 6000 * 8 and ask.count() == 150 * 8 * 4
    pairs = have.join(ask.withColumnRenamed("id", "q"), ["table", "bucket"]).select("q", "id").distinct().count()
    assert pairs < 0.35 * 150 * 6000


def test_lsh_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, None), (9, [0.0, 0.0])], "query_id long, query_vec array<double>")
    out = graph.similarity_lsh(v, q, 5, graph.HyperplaneIndex(dim=2, tables=4, bits=3)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.similarity) for r in out) == [(7, 1, 1, 1.0), (7, 2, 5, 1.0)]
    empty = graph.similarity_lsh(v.limit(0), q, 5, graph.HyperplaneIndex(dim=2))
    assert empty.collect() == []


def test_lsh_writes_no_pairs_and_splits_large_buckets(spark, monkeypatch):
    """Each query's best of its candidates by the index, with copies, ties and buckets cut into cells; pairs stay in their task."""
    import numpy as np
    rnd = np.random.default_rng(9)
    x = np.concatenate([rnd.normal(size=(250, 6)), np.repeat(rnd.normal(size=(1, 6)), 120, axis=0), np.tile([[1.0, 0, 0, 0, 0, 0]], (30, 1)) * np.arange(1, 31)[:, None]])
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(7, x[7].tolist()), (7, x[8].tolist()), (255, x[255].tolist()), (None, x[3].tolist()), (900, [float("nan")] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([r for r in rows if r[0] is not None and (r[0] % 5 == 0 or r[0] == 7)], "query_id long, query_vec array<double>")
    index = graph.HyperplaneIndex(dim=6, tables=3, bits=4, probes=2)
    have, ask = graph.lsh_buckets(v, index, "vec_id", "embedding"), graph.lsh_buckets(q, index, "query_id", "query_vec", probe=True)
    pairs = have.withColumnRenamed("id", "vec_id").join(ask.withColumnRenamed("id", "query_id"), ["table", "bucket"]).select("query_id", "vec_id").distinct()
    sim = F.round(graph._dot("query_vec", "embedding") / (graph._norm("query_vec") * graph._norm("embedding")), 6).alias("similarity")
    ranks = graph.top_k(pairs.filter("vec_id <> 7 AND query_id <> 7").join(q, "query_id").join(v, "vec_id").select("query_id", "vec_id", sim), ["query_id"], [F.col("similarity").desc(), F.col("vec_id").asc()], 9, "vec_id")
    key = lambda df: [str(r) for r in df.filter("query_id <> 7").select("query_id", "rank", "vec_id", "similarity").orderBy("query_id", "rank").collect()]
    alone = v.filter("vec_id <> 7"), q.filter("query_id <> 7")
    found = graph.similarity_lsh(*alone, 9, index)
    want = key(ranks)
    assert key(found) == want and len(want) > 600
    monkeypatch.setattr(graph, "CELL_ROWS", 11)
    monkeypatch.setattr(graph, "CELL_QUERIES", 4)
    split = graph.similarity_lsh(*alone, 9, index)
    assert key(split) == want
    # an id with several vectors is as many rows, each as often as it is there
    twice = graph.similarity_lsh(v.filter("vec_id < 250"), q.filter("query_id = 7"), 9, index).filter("similarity = 1").collect()
    assert sorted((r.query_id, r.vec_id) for r in twice) == [(7, 7)] * 5 + [(7, 8)]
    # what leaves a cell is bounded by its queries, not by its pairs
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") >= 3 and "__id" not in plan


def test_rounding_of_similarities_is_sparks(spark):
    import numpy as np
    x = np.concatenate([np.random.default_rng(2).uniform(-1, 1, 2000), np.arange(-40, 40) / 1e6 + 5e-7, [0.1234565, -0.1234565, 1.0, -1.0, 0.0, 2.5e-6]])
    want = [r.y for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 6).alias("y")).collect()]
    assert graph._rounded(x).tolist() == want


def test_erasure(spark):
    c = spark.createDataFrame([(1, 7, "secret"), (2, 8, "keep")], "decision_id long, user_id long, internal_note string")
    req = spark.createDataFrame([(7,)], "user_id long")
    out = {r.decision_id: r for r in graph.erase_user(c, req).collect()}
    assert out[1].internal_note is None and out[1].content_deleted
    assert out[2].internal_note == "keep" and not out[2].content_deleted


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_each_source_is_scanned_once(spark, scratch):
    spark.createDataFrame([(1, "u", "a", None), (2, None, "b", "x"), (None, "v", "a", "y")], "d long, u string, a string, x string").write.parquet(f"{scratch}/t")
    rows = spark.read.parquet(f"{scratch}/t")
    c = F.col
    source = graph.Source(rows, [graph.Edge("produced_by", c("d"), c("a")), graph.Edge("for_user", c("d"), c("u")), graph.Edge("has_input", c("d"), c("x"), when=c("a") == "b")],
                          [graph.Node("Decision", c("d"), {"a": c("a"), "x": c("x")}), graph.Node("Agent", c("a"), {}), graph.Node("User", c("u"), {"first": c("a")}, c("d") == 1)])
    e = graph.build_edges([source])
    assert _scans(e) == 1
    assert sorted((r.edge_type, r.from_type, r.from_id, r.to_type, r.to_id) for r in e.collect()) == [
        ("for_user", "Session", "1", "User", "u"), ("has_input", "Decision", "2", "Input", "x"),
        ("produced_by", "Decision", "1", "Agent", "a"), ("produced_by", "Decision", "2", "Agent", "b")]
    assert [r.edge_type for r in graph.build_edges([source], ["for_user"]).collect()] == ["for_user"]
    n = graph.build_nodes([source])
    assert _scans(n) == 1
    assert {(r.node_type, r.node_id): r.props for r in n.collect()} == {
        ("Decision", "1"): '{"a":"a"}', ("Decision", "2"): '{"a":"b","x":"x"}', ("Agent", "a"): "{}", ("Agent", "b"): "{}", ("User", "u"): '{"first":"a"}'}
    assert {(r.node_type, r.node_id): (r.out_degree, r.in_degree) for r in graph.nodes_from_edges(e).collect()}[("Decision", "2")] == (2, 0)


def test_all_fifteen_edge_types_have_a_producer(spark):
    from tracefold import constants as C
    from tracefold.plans import q_graph
    sf = "/root/testdata/sf0.01"
    assert {r.edge_type for r in q_graph.edge_table(spark, sf).select("edge_type").distinct().collect()} == {t for t, _, _ in C.EDGE_TYPES}
    ends = {(r.from_type, r.to_type, r.edge_type) for r in q_graph.edge_table(spark, sf).select("from_type", "to_type", "edge_type").distinct().collect()}
    assert ends == {(f, t, e) for e, f, t in C.EDGE_TYPES}


def test_scoped_read_opens_one_folder(spark, scratch):
    import json

    from tracefold.plans import q_graph
    docs = q_graph.nested_documents(spark, "/root/testdata/sf0.001").cache()
    path = f"{scratch}/docs"
    graph.write_documents(docs, path, folders=16)
    want = docs.filter(F.size("retrievals") + F.size("reviews") > 1).orderBy("decision_id").first()
    schema = spark.read.parquet(path).schema
    one = graph.read_decision(spark, path, want.tenant_id, want.decision_id, schema, folders=16)
    got = one.collect()
    assert [{k: r[k] for k in docs.columns} for r in got] == [want.asDict()]
    # one folder of all: by the plan, and by the files that the read opens
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "folder#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(decision_id" in plan.split("PushedFilters: [")[1]
    read = {r.f for r in one.select(F.input_file_name().alias("f")).collect()}
    every = {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(read) == 1 and len(every) > 30
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() <= 1
    # another tenant sees nothing, an unknown id neither; the order of a part is fixed
    assert graph.read_decision(spark, path, "t-none", want.decision_id, schema, folders=16).count() == 0
    assert graph.read_decision(spark, path, want.tenant_id, -5, schema, folders=16).count() == 0
    assert [g["event_id"] for g in json.loads(one.select(F.to_json("guardrails")).first()[0])] == sorted(g.event_id for g in want.guardrails)


def test_documents_keep_decisions_without_parts(spark):
    d = spark.createDataFrame([(1, "t"), (2, "t")], "decision_id long, tenant_id string")
    rows = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 2, "c"), (None, 1, "x"), (9, 1, "y")], "decision_id long, at long, v string")
    out = graph.decision_documents(d, {"events": graph.Part(rows, ["v"], ["at", "v"])})
    assert {r.decision_id: [e.v for e in r.events] for r in out.collect()} == {1: ["c", "a", "b"], 2: []}
