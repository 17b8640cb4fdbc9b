"""Batch twins of the streaming operators (SM2, SM6, SM11).

Each twin computes, over a bounded table, exactly what the streaming job
emits after it has consumed the same rows, so it can be checked against SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.operators.ordering import top_k


def late_events(df: DataFrame, ts_col: str, arrival_col: str, delay_seconds: int = 60,
                batch_seconds: int = 300, stretch_batches: int = 288) -> DataFrame:
    """SM2: which rows a ``withWatermark(ts, delay)`` stream drops as late.

    Rows arrive in micro-batches by arrival time. The watermark used for a
    batch is the maximum event time of all earlier batches minus the delay
    (Spark advances it at batch end). The running maximum has two levels:
    inside stretches of ``stretch_batches`` batches (a day at the defaults),
    and over the stretches' maxima, so no task holds all batches.
    """
    b = df.withColumn("batch", F.floor(F.unix_micros(F.col(arrival_col).cast("timestamp"))
                                       / F.lit(batch_seconds * 1_000_000)).cast("bigint"))
    per = (b.groupBy("batch").agg(F.max(ts_col).alias("__mx"))
            .withColumn("__st", F.floor(F.col("batch") / stretch_batches)))
    earlier = Window.partitionBy("__st").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    inside = per.withColumn("__in", F.max("__mx").over(earlier))
    # one row per stretch: a day of batches each, so a window over all of them stays small
    before = Window.orderBy("__st").rowsBetween(Window.unboundedPreceding, -1)
    st = per.groupBy("__st").agg(F.max("__mx").alias("__mx")).select("__st", F.max("__mx").over(before).alias("__bf"))
    mark = F.greatest("__in", "__bf") - F.make_dt_interval(secs=F.lit(delay_seconds))
    per = inside.join(st, "__st").select("batch", mark.alias("watermark"))
    return (b.join(per, "batch").withColumn("late", F.coalesce(F.col(ts_col) < F.col("watermark"), F.lit(False)))
             .select(*df.columns, "batch", "watermark", "late"))


def rate_limited(df: DataFrame, key: Sequence[str], ts_col: str, id_col: str, limit: int,
                 bucket: str = "1 second") -> DataFrame:
    """SM6: keep at most ``limit`` rows per key and time bucket (earliest first).

    The cap is an exact top-``limit`` per (key, bucket) with the salted
    two-level ranking, so a flooding agent never lands in one sort.
    """
    b = df.withColumn("bucket_start", F.window(ts_col, bucket)["start"])
    return top_k(b, list(key) + ["bucket_start"], [F.col(ts_col).asc(), F.col(id_col).asc()], limit, id_col,
                 rank_col="seq_in_bucket")


def ordered_fold(df: DataFrame, key: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """SM11: state after applying a decision's events in ``order``: the last
    value of each field, the first/last event and the event count. Built on
    ``max_by``/``min_by`` so the fold is a mergeable aggregate."""
    o = F.struct(*[F.col(c) for c in order])
    aggs = [F.count(F.lit(1)).alias("n_events"), F.min(o)[order[-1]].alias("first_event"),
            F.max(o)[order[-1]].alias("last_event")]
    aggs += [F.max_by(F.col(f), o).alias(f"last_{f}") for f in fields]
    return df.groupBy(*key).agg(*aggs)
