"""Operators 6 and 10: archives read back byte by byte; passages against brute force."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import decontaminate as D
from tracefold.llm import warc as W

SMALL = "/root/testdata/sf0.001"


def odd_pages(spark):
    big, other = "<p>" + "x" * 1200, "é" * 500       # 1203 and 1000 bytes
    rows = [(1, "http://a", big), (2, "http://b", big), (3, "u", big), (3, "u2", big), (4, "v", other), (9, "v", other), (5, "s", "short"), (6, "s", "short"), (7, None, None), (8, "", ""),
            (None, "n", big), (10, "line\r\nWARC-Type: fake", "WARC/1.1\r\n\r\n\r\nbody\r\n\r\n" * 60), (11, "w", "y" * 999), (12, "w", "y" * 999), (13, "long", "z" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("clash"))


def expected(rows):
    raw = {i: (r["html"] or "").encode() for i, r in enumerate(rows)}
    best = {}
    for i, r in enumerate(rows):
        if r["page_id"] is not None and len(raw[i]) >= 1000:
            best[raw[i]] = max(best.get(raw[i], -1), r["page_id"])
    out = []
    for i, r in enumerate(rows):
        to = best.get(raw[i]) if r["page_id"] is not None and len(raw[i]) >= 1000 else None
        to = to if to is not None and to > r["page_id"] else None
        out.append((r["page_id"], len(raw[i]), hashlib.sha1(raw[i]).hexdigest(), "revisit" if to is not None else "response", to))
    return out


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archive_gives_back_every_row(spark):
    for pages in (odd_pages(spark), spark.read.parquet(f"{SMALL}/pages.parquet")):
        rows = pages.collect()
        got = W.archive(pages).select(*COLUMNS).collect()
        assert Counter(map(tuple, got)) == Counter(expected(rows))
    assert W.archive(odd_pages(spark).limit(0)).count() == 0


def test_large_groups_of_equal_payloads_are_split(spark, scratch):
    rows = [(i, "u", "x" * 2000 if i % 3 else f"{i}" * 400) for i in range(1, 200)] + [(None, "u", "x" * 2000)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = W.write_warc(pages, f"{scratch}/w", group_rows=10)
    got = W.read_warc(index, f"{scratch}/w", part_bytes=2000)
    assert Counter(map(tuple, got.select(*COLUMNS).collect())) == Counter(expected(pages.collect()))


def test_reading_tasks_grow_with_the_archive(spark, scratch):
    index = W.write_warc(spark.read.parquet(f"{SMALL}/pages.parquet"), f"{scratch}/w")
    total = index.agg(F.sum("length")).first()[0]
    few = W.read_warc(index, f"{scratch}/w").rdd.getNumPartitions()
    many = W.read_warc(index, f"{scratch}/w", part_bytes=total // 40, read_bytes=total // 200).rdd.getNumPartitions()
    assert few <= int(spark.conf.get("spark.sql.shuffle.partitions")) and many >= 20


def test_payloads_and_files(spark, scratch):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(40).repartition(3)
    index = W.write_warc(pages, f"{scratch}/w").cache()
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for r in W.read_warc(index, f"{scratch}/w").filter("record_type = 'response'").collect():
        assert bytes(r["payload"]) == html[r["page_id"]]
    # the records of a file follow each other without a gap, and can be parsed from the file alone
    for file in {r["file"] for r in index.select("file").collect()}:
        with open(f"{scratch}/w/{file}", "rb") as f:
            raw = f.read()
        at = 0
        for r in index.filter(F.col("file") == file).orderBy("offset").collect():
            one = gzip.decompress(raw[at: at + r["length"]])
            assert r["offset"] == at and one[:10] == b"WARC/1.1\r\n" and one[-4:] == b"\r\n\r\n"
            at += r["length"]
        assert at == len(raw)


def test_reads_are_joined_and_bounded(spark):
    rows = [("f", o, 100) for o in range(0, 5000, 100)] + [("f", 90_000, 10), ("f", 200_000, 10), ("g", 7, 3)]
    index = spark.createDataFrame(rows, "file string, offset long, length long")
    got = W.ranges(index, gap=1000, most=50_000).collect()
    assert sorted((r["file"], r["start"], r["stop"], len(r["cuts"])) for r in got) == [("f", 0, 5000, 50), ("f", 90_000, 90_010, 1), ("f", 200_000, 200_010, 1), ("g", 7, 10, 1)]
    split = W.ranges(index.filter("offset < 5000"), gap=1000, most=2000).collect()
    assert all(r["stop"] - r["start"] <= 2100 for r in split) and sum(len(r["cuts"]) for r in split) == 51


# decontamination

def edit_distance_in(item, text):
    """Least edits between the item and any stretch of the text, in full."""
    row = [0] * (len(text) + 1)
    for x in item:
        new = [row[0] + 1]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_distance_in_a_text():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.randrange(5) for _ in range(rng.randrange(1, 8))]
        text = [rng.randrange(5) for _ in range(rng.randrange(0, 15))]
        d, s, e = D.distance_in(item, text)
        assert d == edit_distance_in(item, text) and 0 <= s <= e <= len(text)
        full = list(range(len(item) + 1))                       # distance to that stretch itself
        for j, y in enumerate(text[s:e], 1):
            full = [j] + [0] * len(item) if False else _next(full, item, y, j)
        assert full[-1] == d


def _next(row, item, y, j):
    new = [j]
    for i, x in enumerate(item, 1):
        new.append(min(row[i - 1] + (x != y), row[i] + 1, new[-1] + 1))
    return new


def test_walks_meet_again_after_an_edit():
    rng = np.random.default_rng(3)
    a = rng.integers(1, 1000, 60).astype(np.int32)
    b = np.concatenate([a[:20], a[21:]])                        # one word left out
    pad = np.zeros(100, np.int32)
    same = np.mean([(D.walk(np.concatenate([a, pad]), np.array([0]), 80, s) == D.walk(np.concatenate([b, pad]), np.array([0]), 80, s)).mean() for s in range(50)])
    assert same > 0.6


def test_recall_on_edited_passages_and_clean_texts(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, text(rng.randrange(8, 60))) for i in range(60)]
    docs, planted = [], set()
    for d in range(400):
        w = text(rng.randrange(0, 400))
        if d % 2:
            i, item = rng.choice(items)
            x = list(item)
            for _ in range(rng.randrange(0, D.edits_of(len(item)) + 1)):
                k = rng.randrange(len(x))
                kind = rng.randrange(3)
                x[k:k + 1] = [] if kind == 0 else [rng.choice(vocab)] if kind == 1 else [x[k], rng.choice(vocab)]
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
            planted.add((d, i))
        docs.append((d, w))
    want = {(d, i) for d, w in docs for i, item in items if edit_distance_in(item, w) <= D.edits_of(len(item))}
    assert planted <= want
    join = lambda w: (", " if rng.random() < 0.5 else " ").join(w).upper()
    df = spark.createDataFrame([(d, join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for block in (1_000_000, 300):                              # one block, and many
        got = {(r["doc_id"], r["item_id"]) for r in D.find_passages(df, bench, block_words=block).collect()}
        assert got <= want
        assert len(got & want) >= 0.97 * len(want)
    exact = {(d, i) for d, w in docs for i, item in items if any(w[k:k + len(item)] == item for k in range(len(w)))}
    assert exact <= got


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "One two THREE four five six", "x"), (3, "One two THREE four five six", "x"), (None, "a b one-two three, four five six", "x"), (5, "w " * 30_000, "x")],
                                 "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, " "), (None, "one two"), (4, "one two three four five six")], "item_id long, text string")
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["item_id"], r["distance"], r["start_word"], r["end_word"]) for r in D.find_passages(docs, items).collect())
    assert got == [(-1, 1, 0, 2, 8), (-1, 4, 0, 2, 8), (3, 1, 0, 0, 6), (3, 1, 0, 0, 6), (3, 4, 0, 0, 6), (3, 4, 0, 0, 6)]
    assert D.find_passages(docs.limit(0), items).count() == 0
    assert D.find_passages(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.15])
def test_items_of_the_test_tables(spark, share):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_passages(docs, items, share=share).collect()}
    words = {r["doc_id"]: D.words((r["text"] or "").encode()) for r in docs.collect()}
    for r in items.collect():
        item = D.words(r["text"].encode())
        for d, w in words.items():
            if set(item) & set(w) and any(w[k:k + len(item)] == item for k in range(len(w) - len(item) + 1)):
                assert (d, r["item_id"]) in got
    for d, i in got:
        item = next(D.words(r["text"].encode()) for r in items.collect() if r["item_id"] == i)
        assert edit_distance_in(item, words[d]) <= D.edits_of(len(item), share)
