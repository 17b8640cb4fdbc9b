"""Operators 3 and 9: native jobs against plain Python."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracefold.llm import quality, sharding

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", "   \n\t ", "one", "a a a a a a a a a a a a a a", "x\ny\nx\n\n \ny\n", "# $ % & | < > * ##", "a b c d e f g h i j k a b c d e",
       "é ñ 日本 " * 40, "Ünïcode\x0bvertical\x0cform", "w " * 3000]


def odd_docs(spark):
    rows = [(i, t, "keep me", "x") for i, t in enumerate(ODD)] + [(4, ODD[4], "again", "x"), (None, "no id at all here", "n", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, shard string")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_shards_hold_all_rows_and_near_equal_bytes(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sharding.shard_documents(docs, 4).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(texts)
    load = Counter()
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert max(load.values()) - min(load.values()) <= min(r["size"] for r in got) + max(r["size"] for r in got) * 0.2
    assert not any(w in plan_of(sharding.shard_documents(docs, 4)) for w in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark)
    got = sharding.shard_documents(docs, 16).collect()
    assert len(got) == docs.count()
    assert {r["size"] for r in got if r["doc_id"] in (0, 1)} == {1}
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_map_versions_and_moves(spark, scratch):
    v0 = sharding.first_map(4, 64)
    size = {s: (s * 37 % 11) * 100 for s in range(64)} | {3: 2500}
    v1 = sharding.rebalance(v0, size, 4)
    load = Counter()
    for s, k in v1.items():
        load[k] += size[s]
    assert set(v1) == set(v0) and max(load.values()) - min(load.values()) <= 100
    assert sharding.rebalance(v1, size, 4) == v1                    # settled: nothing moves
    v2 = sharding.rebalance(v1, size, 5)                            # one more shard takes from all others
    assert {k for k in v2.values()} == set(range(5))
    assert all(v2[s] == 4 or v2[s] == v1[s] for s in v1 if size[s] == 0)
    v3 = sharding.rebalance(v2, size, 3)                            # shards 3 and 4 are gone
    assert set(v3.values()) <= {0, 1, 2} and set(v3) == set(v0)
    sharding.store_map(spark, f"{scratch}/map", 0, v0)
    sharding.store_map(spark, f"{scratch}/map", 1, v1)
    assert {r[0]: r[1] for r in sharding.read_map(spark, f"{scratch}/map", 0).collect()} == v0
    assert {r[0]: r[1] for r in sharding.read_map(spark, f"{scratch}/map", 1).collect()} == v1


# quality rules

def brute(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts_against_python(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for docs in (odd_docs(spark), spark.read.parquet(f"{SMALL}/documents.parquet")):
        model = quality.fit(docs, labels)
        got = quality.quality_rules(docs, model)
        assert not any(w in plan_of(got) for w in ("Python", "Arrow", "Cartesian", "NestedLoop", "Exchange"))
        rows = got.collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert tuple(r[c] for c in COLUMNS) == brute(r["text"])
            assert not (r["kept"] and r["base_failed"])


def test_ratio_against_python(spark):
    docs = spark.createDataFrame([(1, "good words here and there " * 4), (2, "good words once more and more of it all then"), (3, "jnk### jnk*** " * 9), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (9, None), (None, 1)], "doc_id long, quality int")
    b = 64
    model = quality.fit(docs, labels, buckets=b)
    grams = {r["doc_id"]: r["g"] for r in quality.with_words(docs).select("doc_id", quality.ngrams(b).alias("g")).collect()}
    assert len(grams[1]) == 20 + 19 and grams[4] == []
    import math
    raw, target = Counter(g for v in grams.values() for g in v), Counter(g for d in (1, 2) for g in grams[d])
    nr, nt = sum(raw.values()), sum(target.values())
    llr = [math.log((target[i] + 1) / (nt + b)) - math.log((raw[i] + 1) / (nr + b)) for i in range(b)]
    rows = {r["doc_id"]: r for r in quality.quality_rules(docs, model, buckets=b, threshold=0.0).collect()}
    for d, g in grams.items():
        want = sum(llr[i] for i in g) / len(g) if g else 0.0
        assert rows[d]["llr"] == pytest.approx(want, abs=1e-5)
    assert rows[2]["kept"] and not rows[3]["kept"] and not rows[4]["kept"]


def test_clean_documents_stay_and_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality_rules(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter(~F.col("base_failed"))
    share = {r[0]: r[1] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()}
    assert share[1] >= 0.99 and share[0] <= 0.1


def test_stage_keeps_columns_with_clashing_names(spark):
    docs = odd_docs(spark)
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    out = quality.passed(docs, model, threshold=-100.0)
    assert out.columns == docs.columns
    assert {r["kept"] for r in out.collect()} <= {"keep me", "again", "n"}
    assert quality.passed(docs.limit(0), model).count() == 0
    assert quality.quality_rules(docs, model).filter("kept is null").count() == 0
