"""The registered jobs ``opN_<name>``: thin wrappers that derive each contract's columns from an operator."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import (decontaminate, lattice_lm, merkle, near_dup, neighbours, quality, sentencepiece_codec, sharding, token_counts, token_store, toxicity,
                           warc, whitening)
from tracefold.llm.oracles import ORACLES  # noqa: F401  (the driver contract reads it here)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def register(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_token_counts(spark, sf_dir):
    """Tokens of every whole text by byte_bpe_50k.json."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


@register
def op2_sentencepiece(spark, sf_dir):
    """Ids of every whole text by piece_bpe_32k.model, decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    # the text itself stays behind: its bytes are compared by number and crc32 once it is decoded
    coded = sentencepiece_codec.encode(docs, vocabulary(PIECES)).select("doc_id", "ids", F.crc32(raw).alias("crc"), F.octet_length(raw).alias("size"))
    coded = sentencepiece_codec.decode(coded, vocabulary(PIECES))
    back = F.col("decoded").cast("binary")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"),
                        F.crc32(back).alias("decoded_crc32"), ((F.crc32(back) == F.col("crc")) & (F.octet_length(back) == F.col("size"))).alias("round_trip"))


@register
def op3_sharding(spark, sf_dir):
    """All documents in 16 shards of near equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


@register
def op4_lattice_lm(spark, sf_dir):
    """Base and model score of every whole text."""
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), vocabulary(PIECES))


@register
def op5_token_store(spark, sf_dir):
    """All documents' ids in ORC files, read back."""
    return token_store.token_store(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


@register
def op6_warc(spark, sf_dir):
    """All pages in WARC files, read back through the index."""
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op7_near_dup(spark, sf_dir):
    """Near-duplicate class of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op8_toxicity(spark, sf_dir):
    """Toxicity score of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@register
def op9_quality_rules(spark, sf_dir):
    """Base counts and verdict of every document; trusted target: documents labelled of good quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.quality_rules(docs, model).drop("text")


@register
def op10_decontamination(spark, sf_dir):
    """Every (document, benchmark item) pair with the item's passage in the document, exactly or slightly edited."""
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op11_embedding_whitening(spark, sf_dir):
    """Every embedding on the 16 leading components of the distinct grid vectors."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register
def op12_merkle_manifest(spark, sf_dir):
    """Proof of every document, and the check of the table with n_chars changed in a seventh of its rows."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return merkle.verify(table(spark, sf_dir, "documents"), fields, "lang", "doc_id", {"n_chars": tampered}).withColumnRenamed("key", "doc_id")


@register
def op13_nearest_neighbours(spark, sf_dir):
    """The 20 nearest of every embedding whose id is divisible by 20, among all others."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, F.col("vec_id") % 20 == 0, 20)
