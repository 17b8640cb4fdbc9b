"""The pipeline and the registry: each stage against what its operator decides, on its own input."""

import os
import re
import subprocess
import sys

import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from tracefold.llm import decontaminate, near_dup, quality, queries, sentencepiece_codec, toxicity
from tracefold.llm.common import frequent, written

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_all_dealt_queries_are_registered():
    names = list(E.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] == list(queries.QUERIES)
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert "pipeline" in names and len(P.STAGES) == 5
    assert set(E.oracle_sql()) <= set(names)


def test_entry_imports_without_the_llm_files(tmp_path):
    for f in ("__spark_entry__.py", "tracefold"):
        subprocess.run(["cp", "-r", f"{ROOT}/{f}", str(tmp_path)], check=True)
    os.rename(tmp_path / "tracefold" / "llm", tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    path = public_tokenizers.path(P.MODEL)
    now = docs
    for name, stage in P.STAGES[:-1]:
        out = written(stage(spark, now, SF), "test-stage")
        assert out.schema == docs.schema
        if name == "toxicity":
            want = toxicity.score(now, toxicity.fit(now, labels)).filter("toxicity < 0.5")
        elif name == "quality":
            want = quality.quality_rules(now, quality.fit(now, labels)).filter("kept")
        elif name == "near_dup":
            rows = near_dup.near_duplicates(now, percent=P.PERCENT).collect()
            assert len({r["component_id"] for r in rows if r["n_shingles"]}) == sum(r["kept"] for r in rows if r["n_shingles"])
            want = spark.createDataFrame([(r["doc_id"],) for r in rows if r["kept"]], "doc_id long")
        else:
            hits = {r["doc_id"] for r in decontaminate.find_passages(now, bench).collect()}
            want = now.filter(~F.col("doc_id").isin(list(hits)))
        assert ids(out) == ids(want)
        now = out
    last = P.STAGES[-1][1](spark, now, SF).collect()
    assert [r["ids"] for r in last] == [x.tolist() for x in sentencepiece_codec.encode_texts(path, [r["text"] for r in last])]
    assert sorted(r["doc_id"] for r in P.run(spark, SF).collect()) == sorted(r["doc_id"] for r in last)


def test_run_over_odd_rows(spark, scratch):
    text = "these are fine words in a line of text that goes on for a while"
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (4, text, "en", "s", 1), (None, text + " more", "en", "s", 1), (5, "w " * 20_000, "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("x")).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    out = P.run(spark, scratch)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "ids"]
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 3, 3]
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{scratch}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/e/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{scratch}/e/benchmark.parquet")
    assert P.run(spark, f"{scratch}/e").count() == 0


def test_near_copies_from_080_go(spark):
    """The stage against all pairs; replacing one word in the middle of n words takes 5 of n - 4 shingles away."""
    rows, want, seen = [], set(), []
    shingles = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    for k, n in enumerate((40, 48, 49, 52, 56, 59, 60, 65, 66, 90)):
        w = [f"t{k}w{i}" for i in range(n)]
        v = [*w[:20], "other", *w[21:]]
        a, b = shingles(w), shingles(v)
        similarity = len(a & b) / len(a | b)
        seen.append(similarity)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        want |= {2 * k} | (set() if similarity >= 0.8 else {2 * k + 1})
    assert 0.8 in seen and sum(0.8 <= x < 0.85 for x in seen) >= 4 and min(seen) < 0.8 and max(seen) > 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in P.duplicates_out(spark, docs, SF).collect()} == want


def test_stages_from_near_copies_on(spark):
    """The near-duplicate stage against near_duplicates at 80 percent, and the stages behind it on what it leaves."""
    now = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:3]:
        last, now = now, written(stage(spark, now, SF), "test-stage")
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    assert name == "near_dup" and ids(now.collect()) == ids(near_dup.near_duplicates(last, percent=80).filter("kept").collect())
    hits = {r["doc_id"] for r in decontaminate.find_passages(now, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    out = P.run(spark, SF).collect()
    assert ids(out) == sorted(r["doc_id"] for r in now.select("doc_id").collect() if r["doc_id"] not in hits)
    assert [r["ids"] for r in out] == [x.tolist() for x in sentencepiece_codec.encode_texts(public_tokenizers.path(P.MODEL), [r["text"] for r in out])]


def test_frequent_rows_keep_within_the_bound(spark):
    df = spark.range(1000).select("id", F.floor(10_000 / (F.col("id") + 1)).alias("n"))
    for most in (0, 1, 10, 100, 999, 5000):
        got = [r["n"] for r in frequent(df, "n", most).collect()]
        rest = 1000 - len(got)
        assert len(got) <= most and (not got or rest == 0 or min(got) > 10_000 // (len(got) + 1) - 1)
