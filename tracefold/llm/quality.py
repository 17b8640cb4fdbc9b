"""Operator 9: quality rules. DataFrame operations only.

Method: hashed n-grams (word bigrams, and the last three characters of each word) are counted for trusted
target documents and for the whole raw corpus; a document's score is the log-likelihood ratio of the two
multinomials, divided by its number of n-grams, and a fixed threshold decides on every document. Base rules on
length and repetition come first.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import SPACES, id_text_crc, written

#: Hash buckets of the n-grams; bounds the tables of both multinomials, which ride along each row as 64 KB.
BUCKETS = 1 << 14
#: Trusted documents that the target multinomial is fitted on, at most.
TARGET_ROWS = 50_000
#: A document is kept if its mean log-likelihood ratio is at least this.
THRESHOLD = -0.5
#: Added to the count of each bucket.
SMOOTHING = 1.0
WINDOW = 5


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _to(n: Column) -> Column:
    """Positions 0 to n - 1; none if n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``__words`` and the words' hashes ``__hw``."""
    return (docs.withColumn("__words", words_of(F.col(text)))
            .withColumn("__hw", F.transform("__words", lambda w: F.xxhash64(w))))


def ngrams(buckets: int) -> Column:
    """Buckets of a row's n-grams, from ``__words`` and ``__hw``; repeated n-grams repeat."""
    pairs = F.transform(_to(F.size("__hw") - 1), lambda i: F.pmod(F.xxhash64(F.get("__hw", i), F.get("__hw", i + 1)), F.lit(buckets)).cast("int"))
    ends = F.transform("__words", lambda w: F.pmod(F.xxhash64(F.right(w, F.lit(3)), F.lit(3)), F.lit(buckets)).cast("int"))
    return F.concat(pairs, ends)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` to rows that have ``__words`` and ``__hw``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("__hw")
    wins = F.transform(_to(n - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get("__hw", i + k) for k in range(WINDOW))))
    docs = docs.withColumns({"__lines": lines, "__wins": wins})
    docs = docs.withColumn("__n_dup", F.size("__wins") - F.size(F.array_distinct("__wins")))
    # only texts with a window found again sort their windows with the positions
    pairs = F.when(F.col("__n_dup") > 0, F.array_sort(F.transform("__wins", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    docs = docs.withColumn("__pairs", pairs)
    again = F.transform("__pairs", lambda p, j: F.when(
        (p["h"] == F.get("__pairs", j - 1)["h"]) | (p["h"] == F.get("__pairs", j + 1)["h"]), p["i"]))
    docs = docs.withColumn("__at", F.array_sort(F.array_compact(again)))
    covered = F.aggregate("__at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return docs.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_repeat_words": F.when(F.col("__n_dup") > 0, covered).otherwise(F.lit(0)).cast("bigint"),
    })


def trusted_sample(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """Ids of trusted documents: labelled of good quality and never of bad; ``rows`` at most, chosen by a hash."""
    ids = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
           .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("q")).filter(F.col("q") == 1))
    return ids.select("doc_id").orderBy(id_text_crc(F.col("doc_id")), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
        target_rows: int = TARGET_ROWS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row, ``llr array<float>``: log of target over raw probability for each bucket.

    The raw corpus is every row of ``docs``; the target is those of :func:`trusted_sample`.
    """
    sample = F.broadcast(trusted_sample(labels, target_rows).select(F.col("doc_id").alias("__id"), F.lit(1).alias("__t")))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("__i"), F.col(text).alias("__text"))
    rows = with_words(rows.join(sample, F.col("__i") == F.col("__id"), "left"), "__text")
    grams = rows.select("__t", F.explode(ngrams(buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__t").alias("target"))
    spark = docs.sparkSession
    counts = written(counts, "ngram-counts")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    totals = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("nr"), F.coalesce(F.sum("target"), F.lit(0)).alias("nt")).collect()[0]
    share = lambda c, n: F.log((F.col(c) + smoothing) / (n + smoothing * buckets))
    llr = every.select("bucket", (share("target", totals["nt"]) - share("raw", totals["nr"])).alias("v"))
    return written(llr.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "v"))), lambda x: x["v"].cast("float")).alias("llr")), "ngram-ratio")


def quality_rules(docs: DataFrame, model: DataFrame, text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with the base counts, ``base_failed, llr, kept``; no row leaves, no shuffle is made.

    Null and empty texts have no words, fail the base rules and are not kept. A text without n-grams has an
    ``llr`` of 0. Columns of ``docs`` named as the outputs are replaced, all others pass through; repeated rows
    get equal verdicts. ``model`` is the one-row table of :func:`fit`.
    """
    own = docs.columns
    rows = base_counts(with_words(docs, text), text)
    rows = rows.withColumn("__grams", ngrams(buckets))
    rows = rows.withColumn("__ratio", model.select("llr").scalar())    # one small array, read once for the whole job
    total = F.aggregate("__grams", F.lit(0.0), lambda a, b: a + F.get("__ratio", b))
    rows = rows.withColumn("llr", F.when(F.size("__grams") > 0, total / F.size("__grams")).otherwise(F.lit(0.0)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # a later filter would be pushed down through all these steps, each reference repeating the steps below it, until
    # the plan is too large to build; optimizers move no filter below a column that isn't deterministic
    here = F.spark_partition_id() >= 0
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & here)
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    return rows.select(*[c for c in own if c not in out], *out)


def passed(docs: DataFrame, model: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    marked = docs.withColumn("__doc", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = quality_rules(marked, model, text, **options).filter("kept")
    return kept.select(*[F.col(f"__doc.`{c}`") for c in docs.columns])


def fitted_on(docs: DataFrame, labels: DataFrame, **options) -> functools.partial:
    """:func:`quality_rules` with a model fitted on these tables."""
    return functools.partial(quality_rules, model=fit(docs, labels, **options))
