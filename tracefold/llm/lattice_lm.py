"""Operator 4: document probabilities from a subword lattice.

Method: a vocabulary of subword pieces spans a lattice over each word; the piece probabilities weight all
segmentations, and a forward recursion in log space returns the word's marginal probability. The vocabulary's
own scores weight the lattice first; one pass of expectation-maximisation over the training words then turns
them into the corpus's piece probabilities, with the own scores as the prior. Words seen in training have an
arc of their own across the whole word, weighted by their count. So the probability of a word is

    G(w) = (c(w) + n1 * lattice(w)) / (N + n1),

with n1, the number of words seen once, as the weight of unseen words. G stays a logarithm throughout, so a word of
any length has its own probability. A document draws its own word
distribution around G (a Dirichlet compound multinomial of concentration ``BETA``), so that words which came
before in a text are likelier to come again; its probability is the product over its words in closed form:

    prod over words w with f occurrences, j < f, of (j + BETA * G(w)), over prod for i < n of (i + BETA).

Training counts come from all training rows by a shuffle; every distinct word is scored once; frequent words go
to the tasks as a dictionary of fixed size, all others are joined by a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import frequent, id_text_crc, slices, written
from tracefold.llm.pieces import SPACE, Vocabulary, load_vocabulary

HEAD_WORDS = 250_000
FLUSH_WORDS = 250_000
BETA = 1000.0
#: Probability of the end of the text in the open-vocabulary part of G.
END_SHARE = 0.01
#: Pseudo-counts that the vocabulary's own scores are worth in the re-estimation, in all.
PRIOR = 1000.0

_vocabularies: dict[str, Vocabulary] = {}


def words(text: bytes | None) -> list[bytes]:
    """A-Z in lower case, then runs of bytes other than ASCII white space."""
    return text.lower().split() if text else []


@dataclass
class Arcs:
    """Piece log-probabilities by place. A word is one first piece (written with a blank in front), any number
    of further pieces, and a stop; either kind sums to one, so the lattice is a distribution over words."""
    first: list[float]
    inner: list[float]
    stop: float
    first_byte: float
    inner_byte: float


def arcs_of(v: Vocabulary, counts: dict[int, float] | None = None) -> Arcs:
    """Arcs from the vocabulary's own scores, or from expected counts with those scores as the prior.

    Key -1 counts stops, -2 and -3 bytes of characters that no piece matches, at the start and inside.
    """
    n = len(v.pieces)
    own = np.array([math.exp(s) if k else 0.0 for s, k in zip(v.scores, v.normal, strict=True)])
    starts = np.array([p.startswith(SPACE) for p in v.pieces])
    w = np.zeros(n)
    for i, c in (counts or {}).items():
        if i >= 0:
            w[i] = c
    extra = lambda k: (counts or {}).get(k, 0.0)
    first = np.where(starts, own, 0) / max(own[starts].sum(), 1e-300) * PRIOR * 0.98 + np.where(starts, w, 0)
    first_byte = PRIOR * 0.02 + extra(-2)
    total = first.sum() + first_byte
    inner = np.where(starts, 0, own) / max(own[~starts].sum(), 1e-300) * PRIOR * 0.65 + np.where(starts, 0, w)
    stop, inner_byte = PRIOR * 0.33 + extra(-1), PRIOR * 0.02 + extra(-3)
    total2 = inner.sum() + stop + inner_byte
    with np.errstate(divide="ignore"):
        return Arcs(np.log(first / total).tolist(), np.log(inner / total2).tolist(), math.log(stop / total2),
                    math.log(first_byte / total / 256), math.log(inner_byte / total2 / 256))


def log_sum(terms: list[float]) -> float:
    """Log of the sum of the exponentials."""
    if len(terms) == 1:
        return terms[0]
    if not terms or (m := max(terms)) == -math.inf:
        return -math.inf
    exp = math.exp
    return m + math.log(sum([exp(t - m) for t in terms]))


def lattice(v: Vocabulary, a: Arcs, word: str) -> tuple[list[list[tuple[int, int, float]]], list[float]]:
    """Arcs (start, piece, log-probability) by the character they end at, and the forward recursion: the log of
    the summed probability of all paths to each position.

    The word has a blank in front, which alone may be a first piece. A character that no piece of that place
    (a piece with a blank in front has none inside) matches alone is spelled in bytes.
    """
    s = SPACE + word
    into: list[list[tuple[int, int, float]]] = [[] for _ in s]
    for end, (size, _, piece) in v.automaton.iter(s):
        into[end].append((end + 1 - size, piece, a.inner[piece] if size <= end else a.first[piece]))
    alpha = [0.0]
    for i, arcs in enumerate(into):
        if not arcs or arcs[-1][0] != i or arcs[-1][2] == -math.inf:        # matches come longest first
            arcs.append((i, -3, a.inner_byte * len(s[i].encode("utf-8", "surrogatepass"))) if i else (0, -2, a.first_byte))
        alpha.append(log_sum([alpha[start] + p for start, _, p in arcs]))
    return into, alpha


def marginal(v: Vocabulary, a: Arcs, word: str) -> float:
    """Log-probability of the word, summed over all segmentations: the recursion of :func:`lattice` without its arcs."""
    s = SPACE + word
    inner, first, inf = a.inner, a.first, -math.inf
    alpha, terms, single, at = [0.0], [], False, 0

    def spelled(i: int) -> float:
        return alpha[i] + (a.inner_byte * len(s[i].encode("utf-8", "surrogatepass")) if i else a.first_byte)

    for end, (size, _, piece) in v.automaton.iter(s):
        while at < end:                 # positions that are over
            if not single:
                terms.append(spelled(at))
            alpha.append(terms[0] if len(terms) == 1 else log_sum(terms))
            at, terms, single = at + 1, [], False
        p = inner[piece] if size <= end else first[piece]
        terms.append(alpha[end + 1 - size] + p)
        single = size == 1 and p != inf
    while at < len(s):
        if not single:
            terms.append(spelled(at))
        alpha.append(terms[0] if len(terms) == 1 else log_sum(terms))
        at, terms, single = at + 1, [], False
    return alpha[-1] + a.stop


def expected(v: Vocabulary, a: Arcs, word: str, counts: dict[int, float]) -> None:
    """Add the expected piece counts of one word (forward-backward) to ``counts``."""
    into, alpha = lattice(v, a, word)
    if alpha[-1] == -math.inf:
        return
    rest = [0.0] * len(alpha)           # share of the probability that passes through a position
    rest[-1] = 1.0
    exp = math.exp
    for i in range(len(into), 0, -1):
        if here := rest[i]:
            at = alpha[i]
            for start, piece, p in into[i - 1]:
                share = exp(alpha[start] + p - at) * here
                rest[start] += share
                counts[piece] += share
    counts[-1] += 1


def _load(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = load_vocabulary(path)
    return _vocabularies[path]


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c, n): occurrences in training rows and in all rows; from the columns ``text binary, held boolean``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            every = list(train.keys() | held.keys())
            c = [train[w] for w in every]
            return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array(c, pa.int64()), pa.array([k + held[w] for k, w in zip(c, every, strict=True)], pa.int64())], names=["word", "c", "n"])

        for batch in slices(batches):
            for text, h in zip(batch.column("text").to_pylist(), batch.column("held").to_pylist(), strict=True):
                (held if h else train).update(words(text))
            if len(train) + len(held) > FLUSH_WORDS:
                yield out()
                train.clear()
                held.clear()
        yield out()

    return rows.select("text", "held").mapInArrow(count, "word binary, c bigint, n bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def piece_counts(counts: DataFrame, model_path: str) -> dict[int, float]:
    """Expected piece counts over all distinct training words, each once, under the vocabulary's own scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _load(model_path)
        a = arcs_of(v)
        sums: defaultdict[int, float] = defaultdict(float)
        for batch in slices(batches, 8192):
            for w in batch.column("word").to_pylist():
                expected(v, a, w.decode("utf-8", "replace"), sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([float(x) for x in sums.values()], pa.float64())], names=["piece", "n"])

    rows = counts.filter("c > 0").select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r[0]: r[1] for r in rows.collect()}         # as many rows as the vocabulary has pieces, at most


def score_words(counts: DataFrame, model_path: str, pieces: dict[int, float], total: int, types: int, once: int) -> DataFrame:
    """(word, c, n, base, g): log10 of the base probability, and the natural logarithm of G, of each distinct word,
    once for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _load(model_path)
        a = arcs_of(v, pieces)
        floor = math.log10(total + types + 1)
        unseen, every = math.log(once * (1 - END_SHARE)), math.log(total + once)
        for batch in slices(batches, 8192):
            c = batch.column("c").to_pylist()
            base = [math.log10(k + 1) - floor for k in c]
            g = [log_sum([unseen + marginal(v, a, w.decode("utf-8", "replace")), math.log(k) if k else -math.inf]) - every
                 for k, w in zip(c, batch.column("word").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("n"), pa.array(base, pa.float64()), pa.array(g, pa.float64())], names=["word", "c", "n", "base", "g"])

    return counts.mapInArrow(run, "word binary, c bigint, n bigint, base double, g double")


def rises(f: int, log_a: float) -> float:
    """log10 of a * (a + 1) * ... * (a + f - 1), from the natural logarithm of a, which itself may be too small for a
    number."""
    first = log_a / math.log(10)
    if f == 1:
        return first
    a = math.exp(log_a)
    if f < 12:
        return first + sum(math.log10(a + j) for j in range(1, f))
    return first + (math.lgamma(a + f) - math.lgamma(a + 1)) / math.log(10)


def score_documents(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", beta: float = BETA,
                    head_words: int = HEAD_WORDS, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """Scores of every whole text: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows whose crc32(id as text) leaves ``held_fold`` are held out, all others train; a null id trains. A null or
    empty text is one end token. Rows of repeated or null ids each keep a row. An empty table gives an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"),
                       F.coalesce(F.pmod(id_text_crc(F.col(doc_id)), F.lit(folds)) == held_fold, F.lit(False)).alias("held"))
    counts = written(word_counts(rows), "word-counts")
    ends = rows.filter(~F.col("held")).count()
    t = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.count(F.when(F.col("c") == 1, 1))).collect()[0]
    total, types, once = int(t[0] or 0) + ends, int(t[1]) + (ends > 0), max(1, int(t[2]))
    table = written(score_words(counts, model_path, piece_counts(counts, model_path), total, types, once), "word-scores")
    head = spark.sparkContext.broadcast({bytes(r[0]): (r[1] > 0, r[2], math.log(beta) + r[3], rises(1, math.log(beta) + r[3])) for r in frequent(table, "n", head_words).select("word", "c", "base", "g").collect()})
    end_base = math.log10(ends + 1) - math.log10(total + types + 1)
    end_score = math.log10(beta * (ends + once * END_SHARE) / (total + once))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value.get
        names = ["row", "doc_id", "held", "n", "known", "base", "score", "word", "freq"]
        types_ = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
        for batch in slices(batches):
            out: list[tuple] = []
            for r, i, h, tx in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "held", "text")), strict=True):
                freq = Counter(words(tx))
                n = sum(freq.values()) + 1
                seen, base, score = int(ends > 0), end_base, end_score - rises(n, math.log(beta))
                for w, f in freq.items():
                    found = known(w)
                    if found is None:
                        out.append((r, None, None, None, None, None, None, w, f))
                    else:
                        in_training, one_base, log_a, once_score = found
                        seen += f * in_training
                        base += f * one_base
                        score += once_score if f == 1 else rises(f, log_a)
                out.append((r, i, h, n, seen, base, score, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), types_, strict=True)] if out else [pa.array([], k) for k in types_], names=names)

    parts = written(rows.mapInArrow(split, "row bigint, doc_id bigint, held boolean, n bigint, known bigint, base double, score double, word binary, freq bigint"), "word-frequencies")
    log_a, ln10 = F.col("g") + math.log(beta), math.log(10)
    a = F.exp(log_a)
    up = log_a / ln10 + F.when(F.col("freq") > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("freq") - 1, F.lit(1)).cast("int")), F.lit(0.0), lambda s, j: s + F.log(a + j) / ln10)).otherwise(0.0)
    rare = (parts.filter(F.col("word").isNotNull()).select("row", "word", "freq").join(table.select("word", "c", "base", "g"), "word")
            .select("row", F.when(F.col("c") > 0, F.col("freq")).otherwise(0).alias("known"), (F.col("freq") * F.col("base")).alias("base"), up.alias("score")))
    docs_part = parts.filter(F.col("word").isNull()).select("row", "doc_id", "held", "n", "known", "base", "score")
    return (docs_part.unionByName(rare, allowMissingColumns=True).groupBy("row")
            .agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), F.max("n").alias("n_tokens"), F.sum("known").alias("n_known"),
                 F.lit(total).cast("bigint").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
            .drop("row"))
