"""Operator 8: toxicity.

Method: weak supervision. Many voters look at a text: lexicons of insults, patterns, and lexicons of word stems
that stand out in labelled rows. A generative label model, fitted on how the voters agree over all documents,
estimates each voter's accuracies and which voters are correlated, and gives each document a posterior label.
A linear classifier on word stems and pattern voters is trained on the posterior labels of a bounded sample of
labelled and unlabelled rows, and scores every whole text.

Labels choose the stems, and the annotator is one more voter of the label model, who abstains on rows without a
label and whose accuracy is estimated like any other. Training targets are posteriors by the text's voters alone, so
no row's own label enters its target. Labels are read only of rows outside the held-out fold. Scores depend on the text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.llm.common import added_schema, id_text_crc, slices, with_columns, written

#: Labelled rows of either label that stems are chosen on, at most, and as many rows without a label: the
#: classifier is trained on all three.
SAMPLE_ROWS = 12_000
#: Stems in the classifier, at most, and in the learned lexicons, at most.
FEATURES, LEARNED = 4096, 400
FOLDS, HELD_FOLD = 5, 0

#: Lexicons by kind of insult, a few languages each.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile imbecil imbécil cretin crétin dummkopf blöd dumm estúpido estupido tonto bête débile abruti",
    "worth": "worthless useless pathetic loser losers failure nobody trash garbage rubbish inútil basura inutile ordure déchet wertlos nutzlos abschaum müll",
    "disgust": "disgusting scum vermin filth filthy gross vile pig pigs swine disgusto asqueroso escoria cerdo dégoûtant vermine racaille salaud widerlich schwein drecksack",
    "mock": "clown clowns joke fool fools jerk creep freak payaso bufón necio bouffon crétine narr trottel clownesk",
    "hate": "hate hateful despise kill die odio muere haine crève hass stirb",
}
_SHOUT = re.compile(r"[A-Z]{3,}!!")
_YOU = re.compile(r"\byou(?:'re| are)?(?: all| such)?(?: an?| the)? (?:idiot|moron|loser|clown|fool|pig|joke|stupid|pathetic|worthless|disgusting)", re.I)
_MASKED = re.compile(r"\b\w+[*@#$]{2,}\w+\b")

#: Letters of any alphabet make words: ASCII characters other than letters divide them.
_TO_BLANK = bytes(b if b > 127 or b in b"abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256))
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Learned lexicons, from the stems that speak strongest for the label to those that speak weakest.
#: Each has two voters: one fires on a word of it, one on two different words.
LEXICONS_LEARNED = 4
PATTERNS = ["you", "masked", "shout"]
VOTERS = [*LEXICONS, *PATTERNS, *(f"stems{i}" for i in range(LEXICONS_LEARNED)), *(f"stems{i}_twice" for i in range(LEXICONS_LEARNED))]


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never read (null id: not held out)."""
    return F.coalesce(F.pmod(id_text_crc(doc_id), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))


def words(text: str | None) -> set[bytes]:
    """A text's distinct words, in lower case."""
    return set(text.lower().encode("utf-8", "replace").translate(_TO_BLANK).split()) if text else set()


def stems(word: bytes) -> list[bytes]:
    """The word, marked by its end, and its beginnings of a few lengths, in characters."""
    w = word.decode("utf-8", "replace")
    return [word + b"$", *(w[:k].encode() for k in STEM_LENGTHS if len(w) >= k)]


class StemIndex(dict):
    """Word -> numbers of its stems that have one; remembers words."""
    def __init__(self, number: dict[bytes, int]):
        self.number = number

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = tuple(n for s in stems(word) if (n := self.number.get(s)) is not None)
        return found

    def of(self, some: set[bytes]) -> set[int]:
        return {n for f in map(self.__getitem__, some) if f for n in f}


@dataclass
class Model:
    number: dict[bytes, int]            # stem -> feature
    weights: np.ndarray                 # of the stems, then of the pattern voters
    intercept: float
    lexicons: list[frozenset[bytes]]    # of the learned voters
    accuracies: dict[str, tuple[float, float]]      # voter, or "annotator" -> (fires if toxic, fires if not)
    correlations: dict[tuple[str, str], float]      # given the label
    prior: float


def patterns_of(text: str | None, some: set[bytes], insults: frozenset[bytes]) -> list[int]:
    """Which of ``PATTERNS`` fire, by their places in the list. Cheap checks come before the expressions."""
    if not text:
        return []
    found = [0] if not insults.isdisjoint(some) and _YOU.search(text) else []
    if ("**" in text or "@@" in text) and _MASKED.search(text):
        found.append(1)
    if "!!" in text and _SHOUT.search(text):
        found.append(2)
    return found


class Voters:
    """Bit v of a text's votes is set if voter v fires; those that don't abstain or vote clean, as the model finds."""
    def __init__(self, lexicons: list[frozenset[bytes]]):
        self.fixed = [frozenset(x.encode() for x in listed.split()) for listed in LEXICONS.values()]
        self.insults = frozenset().union(*self.fixed)
        self.learned = StemIndex({s: i for i, lexicon in enumerate(lexicons) for s in lexicon})

    def votes(self, some: set[bytes], patterns: list[int]) -> int:
        bits = sum((not lexicon.isdisjoint(some)) << v for v, lexicon in enumerate(self.fixed))
        for k in patterns:
            bits |= 1 << len(self.fixed) + k
        once = twice = 0
        for found in map(self.learned.__getitem__, some):
            if found:
                here = 0
                for i in found:
                    here |= 1 << i
                twice |= once & here
                once |= here
        return bits | (once | twice << LEXICONS_LEARNED) << len(self.fixed) + len(PATTERNS)

    def of(self, text: str | None) -> int:
        some = words(text)
        return self.votes(some, patterns_of(text, some, self.insults))


def label_model(patterns: dict[tuple[int, int], float], voters: int, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Fit the generative model to counts of (votes, label); label is 0, 1, or -1 if not known.

    Given the latent truth, voter v fires with probability q[truth, v] (expectation-maximisation). The annotator
    is a voter like the others, who abstains where a row has no label: the last of q is the annotator's.
    Correlations given the truth are estimated from the fitted posterior in each round, and a voter's evidence
    is divided by 1 plus the correlations it has with others, so voters that say the same count once. Returns
    (prior, q, correlations, evidence weights).
    """
    keys = list(patterns)
    bits = np.array([[k[0] >> v & 1 for v in range(voters)] for k in keys], float).reshape(len(keys), voters)
    label = np.array([k[1] for k in keys], int)
    n = np.array([patterns[k] for k in keys], float)
    prior = 0.1
    q = np.array([[0.02] * (voters + 1), [0.4] * voters + [0.95]])
    weight, corr = np.ones(voters), np.zeros((voters, voters))
    for _ in range(rounds):
        post = posterior(bits, prior, q, weight, label)
        mass = np.vstack([n * (1 - post), n * post])
        told = mass * (label >= 0)
        fired = np.hstack([mass @ bits, told @ (label[:, None] == 1)])
        asked = np.hstack([np.repeat(mass.sum(axis=1, keepdims=True), voters, axis=1), told.sum(axis=1, keepdims=True)])
        q_new = (fired + np.array([[0.1], [0.5]])) / (asked + 1.0)
        prior = float(np.clip((mass[1].sum() + 1) / (n.sum() + 10), 1e-4, 0.5))
        corr = np.zeros((voters, voters))
        for y in (0, 1):
            centred = bits - q_new[y, :voters]
            cov = (centred * mass[y][:, None]).T @ centred / (mass[y].sum() + 1)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            corr += np.where((sd[:, None] > 1e-3) & (sd[None] > 1e-3), cov / sd[:, None] / sd[None], 0) / 2
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.maximum(corr, 0).sum(axis=1))
        done = np.abs(q_new - q).max() < 1e-6
        q = q_new
        if done:
            break
    return prior, q, corr, weight


def posterior(bits: np.ndarray, prior: float, q: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Probability that the truth is toxic for each row of votes and its label (-1: none)."""
    says, not_says = np.log(q[1] / q[0]), np.log((1 - q[1]) / (1 - q[0]))
    ratio = bits * says[:-1] + (1 - bits) * not_says[:-1]
    told = np.where(label == 1, says[-1], np.where(label == 0, not_says[-1], 0.0))
    return 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + ratio @ weight + told, -500, 500)))


def labelled_sample(labels: DataFrame, rows: int) -> DataFrame:
    """``doc_id, y, weight``: ``rows`` labelled ids of either label at most, outside the held-out fold, by a hash.

    ``weight`` makes up for the share that was taken. Of several labels of an id the larger counts.
    """
    own = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y")))
    counts = {r[0]: r[1] for r in own.groupBy("y").count().collect()}
    parts = [own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("weight", F.lit(max(1.0, counts.get(y, 0) / rows))) for y in (0, 1)]
    return written(parts[0].union(parts[1]), "labelled-sample")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit voters, label model and classifier.

    Votes are counted over all rows of ``docs``; labels come from at most ``sample_rows`` rows of either label.
    Without labelled rows the learned lexicons are empty and the classifier has an intercept only if no
    document gets a posterior label of toxic.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sample = labelled_sample(labels, sample_rows)
    known = written(rows.join(F.broadcast(sample), "doc_id"), "labelled-texts")       # 2 * sample_rows ids at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            every = list(sums[0].keys() | sums[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), *(pa.array([s[x] for x in every], pa.int64()) for s in sums)], names=["stem", "n0", "n1"])

        for batch in slices(batches, 256):
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                sums[y].update({s for w in words(t) for s in stems(w)})
            if len(sums[0]) + len(sums[1]) > 500_000:
                yield out()
                sums[0].clear()
                sums[1].clear()
        yield out()

    stats = written(known.select("text", "y").mapInArrow(count, "stem binary, n0 bigint, n1 bigint").groupBy("stem")
                    .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter("n0 + n1 >= 4"), "stem-counts")
    totals = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    m0, m1 = totals.get(0, 0), totals.get(1, 0)
    p0, p1 = (F.col("n0") + 0.5) / (m0 + 1), (F.col("n1") + 0.5) / (m1 + 1)
    gap = F.log(p1 / p0) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))       # log-odds in standard deviations
    top = stats.withColumn("z", gap).withColumn("ratio", F.log(p1 / p0)).orderBy(F.desc(F.abs("z")), "stem").limit(FEATURES).collect()
    number = {bytes(r["stem"]): i for i, r in enumerate(top)}
    strong = sorted((r for r in top if r["z"] > 3 and r["ratio"] > 1.5), key=lambda r: (-r["z"], bytes(r["stem"])))[:LEARNED]
    strong.sort(key=lambda r: (-r["ratio"], bytes(r["stem"])))
    part = -(-len(strong) // LEXICONS_LEARNED)
    lexicons = [frozenset(bytes(r["stem"]) for r in strong[i * part: (i + 1) * part]) for i in range(LEXICONS_LEARNED)]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicons)
        for batch in slices(batches, 256):
            got = [voters.of(t) for t in batch.column("text").to_pylist()]
            yield with_columns(batch.select([n for n in batch.schema.names if n != "text"]), {"votes": pa.array(got, pa.int32())})

    voted = rows.select("text").mapInArrow(vote, "votes int").groupBy("votes").count()
    patterns: dict[tuple[int, int], float] = {}
    for r in voted.collect():                           # 2 ** len(VOTERS) rows at most
        patterns[r["votes"], -1] = float(r["count"])
    seen = written(known.select("text", "doc_id", "y", "weight").mapInArrow(vote, "doc_id bigint, y int, weight double, votes int"), "labelled-votes")
    for r in seen.groupBy("votes", "y").agg(F.count("*").alias("n")).collect():
        patterns[r["votes"], r["y"]] = float(r["n"])
        patterns[r["votes"], -1] = max(0.0, patterns.get((r["votes"], -1), 0.0) - r["n"])
    prior, q, corr, weight = label_model(patterns, len(VOTERS))
    weights, intercept = train(known.select("text", "weight").union(unlabelled_sample(rows, labels, sample_rows)), number, lexicons, prior, q, weight)
    names = [*VOTERS, "annotator"]
    return Model(number, weights, intercept, lexicons, {v: (float(q[1, i]), float(q[0, i])) for i, v in enumerate(names)},
                 {(names[i], names[j]): float(corr[i, j]) for i in range(len(VOTERS)) for j in range(i) if abs(corr[i, j]) > 0.05}, prior)


def unlabelled_sample(rows: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text, weight``: ``most`` rows at most, by a hash of the id, whose labels are not read (none, or held out)."""
    read = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    other = rows.filter("doc_id is not null").select("doc_id").distinct().join(read, "doc_id", "left_anti")
    total = other.count()
    ids = written(other.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "unlabelled-sample")
    return rows.join(F.broadcast(ids), "doc_id").select("text", F.lit(max(1.0, total / most)).alias("weight"))     # ``most`` ids


def train(sample: DataFrame, number: dict[bytes, int], lexicons: list[frozenset[bytes]], prior: float, q: np.ndarray, weight: np.ndarray,
          rounds: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on stems and pattern voters, trained on the posterior labels of ``sample`` (``text, weight``).

    The sample is bounded, so its rows (a few feature numbers each) are fitted on the driver. The lexicons' words
    reach the classifier as stems.
    """
    n_features = len(number) + len(PATTERNS)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, voters = StemIndex(number), Voters(lexicons)
        for batch in slices(batches, 256):
            found, bits = [], []
            for t in batch.column("text").to_pylist():
                some = words(t)
                patterns = patterns_of(t, some, voters.insults)
                found.append([*sorted(index.of(some)), *(len(number) + k for k in patterns)])
                bits.append(voters.votes(some, patterns))
            yield pa.RecordBatch.from_arrays([batch.column("weight"), pa.array(bits, pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["weight", "votes", "found"])

    rows = sample.mapInArrow(features, "weight double, votes int, found array<int>").toPandas()
    if not len(rows):
        return np.zeros(n_features), math.log(prior / (1 - prior))
    bits = np.array([[b >> v & 1 for v in range(len(VOTERS))] for b in rows["votes"]], float)
    target = posterior(bits, prior, q, weight, np.full(len(rows), -1))          # the annotator abstains
    size = rows["found"].map(len).to_numpy()
    row = np.repeat(np.arange(len(rows)), size)
    col = np.concatenate([np.asarray(x, int) for x in rows["found"]]) if size.sum() else np.zeros(0, int)
    share = rows["weight"].to_numpy() / rows["weight"].sum()
    w, b = np.zeros(n_features), math.log(prior / (1 - prior))
    # gradient steps with a scale of its own for each feature (diagonal of the curvature's bound)
    scale = np.bincount(col, weights=share[row] * np.maximum(size[row], 1), minlength=n_features)[: n_features] / 4 + penalty
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        z = b + vb * 0.9 + np.bincount(row, weights=(w + 0.9 * vw)[col], minlength=len(rows))
        error = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        grad = np.bincount(col, weights=error[row], minlength=n_features)[: n_features] + penalty * (w + 0.9 * vw) * 0.05
        vw = 0.9 * vw - grad / scale
        vb = 0.9 * vb - error.sum() / 2.0
        w, b = w + vw, b + vb
    return w, b


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` with a column ``toxicity``: the probability of the label toxic, from the text alone.

    Null and empty texts and texts without known stems or patterns get the classifier's intercept. A column named as the
    output is replaced, all others pass through; repeated rows get equal scores; an empty table stays empty.
    """
    number, weights, intercept = model.number, model.weights, model.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, insults = StemIndex(number), Voters([]).insults
        for batch in slices(batches, 256):
            z = []
            for t in batch.column(text).to_pylist():
                some = words(t)
                z.append(intercept + sum(weights[i] for i in sorted(index.of(some))) + sum(weights[len(number) + k] for k in patterns_of(t, some, insults)))
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -50, 50)))
            yield with_columns(batch, {out: pa.array(p, pa.float64())})

    return docs.mapInArrow(run, added_schema(docs.schema, [T.StructField(out, T.DoubleType())]))
