"""Operators 4 and 8: against plain Python, and on held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracefold.llm import lattice_lm as L
from tracefold.llm import toxicity as X

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return L.load_vocabulary(MODEL)


def test_arcs_are_distributions(vocabulary):
    for counts in (None, {10_000: 50.0, -1: 20.0, -2: 1.0, -3: 2.0}):
        a = L.arcs_of(vocabulary, counts)
        assert math.isclose(sum(map(math.exp, a.first)) + 256 * math.exp(a.first_byte), 1, rel_tol=1e-9)
        assert math.isclose(sum(map(math.exp, a.inner)) + math.exp(a.stop) + 256 * math.exp(a.inner_byte), 1, rel_tol=1e-9)


def all_paths(v, a, word):
    """Sum over every segmentation, by recursion over the string."""
    s = L.SPACE + word
    ids = {p: i for i, p in enumerate(v.pieces) if v.normal[i]}

    def rest(i):
        if i == len(s):
            return math.exp(a.stop)
        total = 0.0
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in ids:
                total += math.exp((a.inner if i else a.first)[ids[s[i:j]]]) * rest(j)
        if s[i] not in ids:
            total += (math.exp(a.inner_byte * len(s[i].encode())) if i else math.exp(a.first_byte)) * rest(i + 1)
        return total

    return rest(0)


def test_forward_recursion_sums_all_segmentations(vocabulary):
    a = L.arcs_of(vocabulary)
    for w in ["a", "the", "thand", "ñandú", "日本x", "q́z", "zzzzzz", "therein"]:
        assert math.isclose(math.exp(L.marginal(vocabulary, a, w)), all_paths(vocabulary, a, w), rel_tol=1e-9)
    assert L.marginal(vocabulary, a, "x" * 20_000) < -1000          # long words neither fail nor underflow


def test_expected_counts_cover_each_character_once(vocabulary):
    a = L.arcs_of(vocabulary)
    for w in ["the", "thand", "日本x", "therein"]:
        counts = Counter()
        L.expected(vocabulary, a, w, counts)
        chars = sum(n * (len(vocabulary.pieces[i]) if i >= 0 else 1) for i, n in counts.items() if i != -1)
        assert math.isclose(chars, len(w) + 1, rel_tol=1e-9) and counts[-1] == 1


def plain_scores(rows, v):
    held = {r: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for r, (i, _) in enumerate(rows)}
    toks = [L.words(t.encode() if t else None) for _, t in rows]
    c = Counter(w for r, ws in enumerate(toks) if not held[r] for w in ws)
    ends = sum(not h for h in held.values())
    n, types, once = sum(c.values()) + ends, len(c) + (ends > 0), max(1, sum(k == 1 for k in c.values()))
    sums = Counter()
    for w in c:
        L.expected(v, L.arcs_of(v), w.decode("utf-8", "replace"), sums)
    a = L.arcs_of(v, sums)
    out = []
    for r, (i, _) in enumerate(rows):
        base = score = 0.0
        seen = Counter()
        for k, w in enumerate([*toks[r], None]):
            count = ends if w is None else c[w]
            g = (count + once * (L.END_SHARE if w is None else (1 - L.END_SHARE) * math.exp(L.marginal(v, a, w.decode("utf-8", "replace"))))) / (n + once)
            base += math.log10((count + 1) / (n + 1 * (types + 1)))
            score += math.log10((seen[w] + L.BETA * g) / (k + L.BETA))          # word after word
            seen[w] += 1
        out.append((i, held[r], len(toks[r]) + 1, sum(c[w] > 0 for w in toks[r]) + (ends > 0), n, base, score))
    return out


@pytest.mark.parametrize("head", [0, 4, 10_000])
def test_scores_against_word_after_word(spark, vocabulary, head):
    rows = [(i, t) for i, t in enumerate([None, "", " \n ", "The the THE cat", "a cat sat on the mat\x0bmat", "unknownword qqqq", "é É é", "x " * 40, "the cat"] * 3)]
    rows += [(4, "the cat"), (4, "the cat"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("word", F.lit(1))
    got = sorted(map(tuple, L.score_documents(docs, MODEL, head_words=head).collect()), key=repr)
    want = sorted(plain_scores(rows, vocabulary), key=repr)
    assert len(got) == len(want)
    key = lambda r: (-1 if r[0] is None else r[0], r[2], round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def log_paths(v, a, word):
    """Log of the sum over every segmentation, place by place with numpy, whatever its size."""
    s = L.SPACE + word
    ids = {p: i for i, p in enumerate(v.pieces) if v.normal[i]}
    longest = max(map(len, ids))
    to = np.full(len(s) + 1, -np.inf)
    to[0] = 0.0
    for i in range(len(s)):
        arcs = a.inner if i else a.first
        for j in range(i + 1, min(len(s), i + longest) + 1):
            p = arcs[ids[s[i:j]]] if s[i:j] in ids else -math.inf
            if j == i + 1 and p == -math.inf:
                p = a.inner_byte * len(s[i].encode()) if i else a.first_byte
            to[j] = np.logaddexp(to[j], to[i] + p)
    return to[-1] + a.stop


@pytest.mark.parametrize("head", [0, 10_000])
def test_words_of_any_length_have_their_own_probability(spark, vocabulary, head):
    long = ["天地玄黄宇宙洪荒" * 400, "x" * 3000, "Zm9vYmFy" * 300, "letters" * 100, "a▁b", "▁" * 50]
    train = [(0, "the cat sat on the mat"), (2, "a cat"), (3, long[1])]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:2 * len(long)]
    assert not {0, 2, 3} & set(held)
    rows = train + [(i, t) for i, t in zip(held, [*long, *(f"{w} the {w}" for w in long)], strict=True)]
    c = Counter(w for _, t in train for w in L.words(t.encode()))
    n, once = sum(c.values()) + len(train), sum(k == 1 for k in c.values())
    sums = Counter()
    for w in c:
        L.expected(vocabulary, L.arcs_of(vocabulary), w.decode(), sums)
    a = L.arcs_of(vocabulary, sums)
    got = {r["doc_id"]: r["score"] for r in L.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, head_words=head).collect()}
    for i, t in rows:
        want, seen = 0.0, Counter()
        for k, w in enumerate([*L.words(t.encode()), None]):
            g = math.log(once * L.END_SHARE) if w is None else math.log(once * (1 - L.END_SHARE)) + log_paths(vocabulary, a, w.decode())
            count = len(train) if w is None else c[w]
            g = np.logaddexp(g, math.log(count) if count else -np.inf) - math.log(n + once)
            prior = g + math.log(L.BETA)
            want += (np.logaddexp(prior, math.log(seen[w])) if seen[w] else prior) - math.log(k + L.BETA)
            seen[w] += 1
        assert got[i] == pytest.approx(want / math.log(10), rel=1e-9)
    assert got[held[0]] < -4000                 # 3,200 characters, not cut off


def test_lm_empty_table(spark):
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_training_rows_only(spark):
    """Changing a held-out text changes no other row's score."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    other = docs.withColumn("text", F.when(held, F.lit("brand new words")).otherwise(F.col("text")))
    score = lambda d: {r["doc_id"]: r["score"] for r in L.score_documents(d, MODEL).filter("not held_out").collect()}
    a, b = score(docs), score(other)
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-9) for i in a)


# toxicity

def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(4)
    n = 40_000
    y = rng.random(n) < 0.2
    fire = lambda p1, p0: np.where(y, rng.random(n) < p1, rng.random(n) < p0)
    a, b, c, d = fire(0.7, 0.01), fire(0.6, 0.02), fire(0.5, 0.05), fire(0.8, 0.1)
    twin = np.where(rng.random(n) < 0.95, a, fire(0.7, 0.01))       # nearly a copy of a
    votes = np.stack([a, b, c, d, twin], 1)
    code = (votes << np.arange(5)).sum(1)
    patterns = Counter((int(k), -1) for k in code[2000:])
    patterns.update((int(k), int(t)) for k, t in zip(code[:2000], y[:2000], strict=True))
    prior, q, corr, weight = X.label_model(dict(patterns), 5)
    assert abs(prior - 0.2) < 0.05
    assert abs(q[1, 1] - 0.6) < 0.08 and abs(q[0, 1] - 0.02) < 0.03 and abs(q[1, 3] - 0.8) < 0.1
    assert q[1, 5] > 0.97 and q[0, 5] < 0.03                        # the annotator, who is right here
    assert corr[0, 4] > 0.5 and abs(corr[1, 2]) < 0.2
    assert weight[0] < 0.7 < weight[1]                              # twins share their evidence


def test_stems_and_words():
    assert X.words("Idiot! idiot\nÉté-x 12") == {"idiot".encode(), "été".encode(), b"x"}
    assert X.stems("étéside".encode())[1:] == ["étés".encode(), "étési".encode(), "étésid".encode(), "étéside".encode()]
    assert X.words(None) == set()


def test_label_model_doubts_a_poor_annotator():
    rng = np.random.default_rng(5)
    n = 20_000
    y = rng.random(n) < 0.3
    votes = np.stack([np.where(y, rng.random(n) < 0.8, rng.random(n) < 0.05) for _ in range(4)], 1)
    told = np.where(rng.random(n) < 0.8, y, ~y)                     # wrong in a fifth of the rows
    code = (votes << np.arange(4)).sum(1)
    _, q, _, _ = X.label_model(Counter(zip(code.tolist(), told.astype(int).tolist(), strict=True)), 4)
    assert abs(q[1, 4] - 0.8) < 0.06 and abs(q[0, 4] - 0.2) < 0.06


def test_votes():
    some = [frozenset({b"idiot", "r\u00e9eux".encode()}), frozenset({b"abcd"}), frozenset(), frozenset()]
    voters = X.Voters(some)
    fired = lambda t: {X.VOTERS[v] for v in range(len(X.VOTERS)) if voters.of(t) >> v & 1}
    assert fired("such an IDIOT") == {"mind", "stems0"}
    assert fired("you are an idiot, r\u00e9euxa") == {"mind", "you", "stems0", "stems0_twice"}
    assert fired("abcde abcdf") == {"stems1", "stems1_twice"} and fired("abcde abcde") == {"stems1"}
    assert fired("STOP!! f**k") == {"shout", "masked"} and fired("") == fired(None) == set()


def test_scores_match_a_plain_scorer(spark):
    """Each score anew from the model's weights: the stems of the text's words, and its patterns."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = X.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert len(model.weights) == len(model.number) + len(X.PATTERNS)
    insults = {w.encode() for listed in X.LEXICONS.values() for w in listed.split()}
    for r in X.score(docs, model).collect():
        raw = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in (r["text"] or "").lower()).split(" ")
        heads = {(w[:k]).encode() for w in raw for k in X.STEM_LENGTHS if len(w) >= k} | {w.encode() + b"$" for w in raw if w}
        z = model.intercept + sum(model.weights[model.number[s]] for s in heads if s in model.number)
        hits = [bool(insults & {w.encode() for w in raw}) and X._YOU.search(r["text"] or ""), X._MASKED.search(r["text"] or ""), X._SHOUT.search(r["text"] or "")]
        z += sum(model.weights[len(model.number) + k] for k, hit in enumerate(hits) if hit)
        assert r["toxicity"] == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, z)))), rel=1e-9)


def test_held_out_rows_are_told_apart(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = X.fit(docs, labels)
    got = X.score(docs, model).join(labels, "doc_id").filter(X.held_out(F.col("doc_id"))).select("toxic", "toxicity", "lang").collect()
    pos, neg = [r["toxicity"] for r in got if r["toxic"]], [r["toxicity"] for r in got if not r["toxic"]]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.8 and np.mean([n >= 0.5 for n in neg]) < 0.03
    # labels of the held-out fold are never read
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = X.fit(docs, flipped)
    assert again.number == model.number and np.allclose(again.weights, model.weights)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "you are an idiot and a moron, worthless scum", "c"), (3, "you are an idiot and a moron, worthless scum", "c"), (None, "fine words", "d"), (5, "w " * 50_000, "e")],
                                 "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (1, 0), (2, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    rows = X.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r["toxicity"] <= 1 for r in rows)
    assert rows[2]["toxicity"] == rows[3]["toxicity"]
    none = X.fit(docs.limit(0), labels.limit(0))
    assert X.score(docs.limit(0), none).count() == 0
    assert all(r["toxicity"] < 0.5 for r in X.score(docs, none).collect())
