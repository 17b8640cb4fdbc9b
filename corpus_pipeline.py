"""A corpus pipeline: five stages, each an operator of ``tracefold.llm``, over the documents table.

Each stage takes (spark, docs, sf_dir), works on every row that the one before kept, and returns the rows that
stay, in the columns of ``documents``; the last one adds the token ids. ``run`` chains them over files in the
shared folder, so a lost executor repeats one stage's work at most.

A null document id is never taken for a duplicate or for a benchmark passage. Null and empty texts are no
documents: the quality stage rejects them. An empty table gives an empty result.
"""

from __future__ import annotations

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import decontaminate, near_dup, quality, sentencepiece_codec, toxicity
from tracefold.llm.common import written

MODEL = "piece_bpe_32k.model"
#: Near copies share so many percent of the union of their five-word shingles; op7's contract has 85, the stage 80.
PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is not among ``ids``; rows without an id stay."""
    return docs.join(ids.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model is fitted on the labels outside the held-out fold."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="__toxicity").filter(F.col("__toxicity") < 0.5).drop("__toxicity")


def quality_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    return quality.passed(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 or more), the document with the smallest id stays."""
    return _without(docs, near_dup.near_duplicates(docs, percent=PERCENT).filter(~F.col("kept")))


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return _without(docs, decontaminate.find_passages(docs, _table(spark, sf_dir, "benchmark")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their SentencePiece ids."""
    return sentencepiece_codec.encode(docs, vocabulary(MODEL))


STAGES = [("toxicity", toxic_out), ("quality", quality_out), ("near_dup", duplicates_out), ("decontamination", leaks_out), ("sentencepiece", encoded)]

#: Fitted models, signatures and Viterbi paths have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
