"""Skew-safe ordering primitives (WN3-WN5, WN10, JN13 top-k).

A plain ``row_number() OVER (PARTITION BY key ORDER BY t)`` sorts a whole key
in one task; if one session or agent holds a third of all rows, that task is
the job. These helpers split each key into buckets, rank inside buckets,
and stitch buckets together from small per-bucket aggregates, so the result
is exact and no task sees more than one bucket of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.session import cut_lineage


def _bucket(order_col: str, width: int) -> Column:
    return F.floor(F.col(order_col) / F.lit(width)).cast("bigint")


def sequence_within(df: DataFrame, key: Sequence[str], order_col: str, bucket_width: int = 65536,
                    rank_col: str = "seq", prev_col: str = "prev", next_col: str = "next") -> DataFrame:
    """Exact 1-based position, previous and next ``order_col`` value per key.

    ``order_col`` must be an integer that is unique within a key (a turn or
    step number, an event time in micros). Rows are ranked inside
    ``(key, order_col div bucket_width)``; each bucket's offset and the
    neighbouring values across bucket edges come from per-bucket aggregates
    (one row per bucket, so that side stays small).
    """
    key = list(key)
    b = df.withColumn("__b", _bucket(order_col, bucket_width))
    w_in = Window.partitionBy(*key, "__b").orderBy(order_col)
    local = (b.withColumn("__r", F.row_number().over(w_in))
              .withColumn("__p", F.lag(order_col).over(w_in))
              .withColumn("__n", F.lead(order_col).over(w_in)))
    agg = b.groupBy(*key, "__b").agg(F.count(F.lit(1)).alias("__cnt"), F.min(order_col).alias("__mn"),
                                     F.max(order_col).alias("__mx"))
    w_b = Window.partitionBy(*key).orderBy("__b")
    agg = (agg.withColumn("__off", F.coalesce(F.sum("__cnt").over(w_b.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0)))
              .withColumn("__pmx", F.lag("__mx").over(w_b))
              .withColumn("__nmn", F.lead("__mn").over(w_b))
              .drop("__cnt", "__mn", "__mx"))
    j = local.join(agg, key + ["__b"])
    return (j.withColumn(rank_col, (F.col("__r") + F.col("__off")).cast("bigint"))
             .withColumn(prev_col, F.coalesce(F.col("__p"), F.col("__pmx")))
             .withColumn(next_col, F.coalesce(F.col("__n"), F.col("__nmn")))
             .drop("__b", "__r", "__p", "__n", "__off", "__pmx", "__nmn"))


def top_k(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, salt_col: str,
          buckets: int = 512, rank_col: str = "rank") -> DataFrame:
    """Exact top-``k`` rows per key under ``order`` (a total order).

    Stage 1 keeps the top ``k`` inside ``(key, hash(salt) mod buckets)``;
    stage 2 ranks at most ``k * buckets`` survivors per key. Every row of the
    true top ``k`` is in the top ``k`` of its own bucket, so nothing is lost.
    Size ``buckets`` so the largest key's rows / buckets fits one task
    comfortably (e.g. rows of the hottest key / 10 million); stage 2 stays
    small as long as ``k * buckets`` does.
    """
    key = list(key)
    s = df.withColumn("__salt", F.pmod(F.xxhash64(F.col(salt_col)), F.lit(buckets)))
    w1 = Window.partitionBy(*key, "__salt").orderBy(*order)
    s = s.withColumn("__r1", F.row_number().over(w1)).filter(F.col("__r1") <= k)
    w2 = Window.partitionBy(*key).orderBy(*order)
    return (s.withColumn(rank_col, F.row_number().over(w2).cast("bigint"))
             .filter(F.col(rank_col) <= k).drop("__salt", "__r1"))


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[str], count_col: str | None = None) -> DataFrame:
    """WN5/SM3 batch twin: one row per key, the first under ``order``.

    ``min_by`` over a struct of the row is a mergeable aggregate, so a key
    delivered many times is combined map-side.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    o = F.struct(*[F.col(c) for c in order])
    aggs = [F.min_by(F.struct(*[F.col(c) for c in rest]), o).alias("__row")]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    out = df.groupBy(*key).agg(*aggs)
    return out.select(*key, *[F.col("__row")[c].alias(c) for c in rest], *([count_col] if count_col else []))


#: Rows of one key that a join task takes before the key is split, and hot keys that may be broadcast.
HOT_ROWS = 500_000
HOT_KEYS_BROADCAST = 100_000


def split_keys(rows: DataFrame, keys: Sequence[str], hot: DataFrame, part: str = "__part") -> DataFrame:
    """``rows`` with the part that each goes to: by a hash of the whole row, 0 for keys that ``hot`` lacks."""
    on = None
    for k in keys:
        same = rows[k].eqNullSafe(hot[f"__{k}"])
        on = same if on is None else on & same
    cols = [rows[c] for c in rows.columns]
    return rows.join(hot, on, "left").select(*cols, F.coalesce(F.pmod(F.xxhash64(*cols), F.col("__parts")), F.lit(0)).cast("int").alias(part))


def join_split(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", hot_rows: int | None = None) -> DataFrame:
    """``rows.join(lookup, keys, how)`` (left or inner) for many rows and few lookup rows per key.

    Rows per key are counted first (combined map-side). A key with more than ``hot_rows`` rows is split into parts of
    about that size and its lookup rows are copied to each part, so a key that holds a third of all rows, the null key
    too, fills several tasks. Without such keys the join is Spark's own. Rows equal in every column share a part.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    hot = cut_lineage(n.select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("__n") / F.lit(limit)).cast("int").alias("__parts")))
    n_hot = hot.count()
    if n_hot == 0:
        return rows.join(lookup, list(keys), how)
    small = F.broadcast(hot) if n_hot <= HOT_KEYS_BROADCAST else hot
    on = None
    for k in keys:
        same = lookup[k] == hot[f"__{k}"]
        on = same if on is None else on & same
    copies = lookup.join(small, on, "left").select(
        *[lookup[c] for c in lookup.columns], F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1)).alias("__part"))
    return split_keys(rows, keys, small).join(copies, [*keys, "__part"], how).drop("__part")
