"""Usage, cost, manifest and stage metrics (AG7-AG9).

All aggregates are algebraic (sum / count / min / max), so Spark runs them as
a partial aggregate before the shuffle and only one row per group and map
task crosses the network. Money is summed as DECIMAL so the result does not
depend on row order; it is cast to DOUBLE once at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,6)"


def money_sum(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast(MONEY)).cast("double")


def usage_by_window(df: DataFrame, window: str = "1 hour",
                    keys: Sequence[str] = ("tenant_id", "agent_id", "model"),
                    ts: str = "ts", input_tokens: str = "input_tokens",
                    output_tokens: str = "output_tokens", cost: str = "cost_usd") -> DataFrame:
    """AG7: tokens, cost and request count per tumbling window and key.

    The same expression works on a stream (SM5) once a watermark is set.
    """
    w = F.window(ts, window)
    return (df.groupBy(w.alias("w"), *keys)
              .agg(F.count(F.lit(1)).alias("request_count"),
                   F.sum(input_tokens).cast("bigint").alias("input_tokens"),
                   F.sum(output_tokens).cast("bigint").alias("output_tokens"),
                   money_sum(cost).alias("cost_usd"))
              .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      *keys, "request_count", "input_tokens", "output_tokens", "cost_usd"))


def latency_bucket(latency: Column, bounds: Sequence[int]) -> Column:
    """Upper bound label of the histogram bucket holding ``latency``."""
    expr = None
    for b in bounds:
        cond = latency <= b
        expr = F.when(cond, F.lit(f"le_{b}")) if expr is None else expr.when(cond, F.lit(f"le_{b}"))
    return expr.otherwise(F.lit("inf"))


def stage_metrics(df: DataFrame, class_col: str, outcome_col: str, latency_col: str,
                  bounds: Sequence[int] = (10, 50, 100, 250)) -> DataFrame:
    """AG9: events by class x outcome with a latency histogram.

    A histogram is mergeable across partitions and stream batches; exact
    percentiles would need every value of a group in one task.
    """
    return (df.groupBy(F.col(class_col).alias("event_class"), F.col(outcome_col).alias("outcome"),
                       latency_bucket(F.col(latency_col), bounds).alias("latency_bucket"))
              .agg(F.count(F.lit(1)).alias("n_events"),
                   F.min(latency_col).alias("min_latency_ms"),
                   F.max(latency_col).alias("max_latency_ms")))


def latency_percentiles(df: DataFrame, keys: Sequence[str], latency_col: str,
                        quantiles: Sequence[float] = (0.5, 0.95, 0.99), accuracy: int = 10000) -> DataFrame:
    """AG9 percentiles with a bounded-memory sketch per group."""
    return df.groupBy(*keys).agg(
        *[F.percentile_approx(latency_col, q, accuracy).alias(f"p{int(q * 100)}") for q in quantiles])


#: Size of a quantile sketch: ranks are off by less than 1 % of the rows with 99 % confidence.
SKETCH_K = 400


def latency_sketches(df: DataFrame, keys: Sequence[str], latency_col: str, k: int = SKETCH_K) -> DataFrame:
    """AG9: a mergeable quantile sketch (KLL) and the row count per group, to be stored, e.g. per stage, class and day.

    A sketch has a few kilobytes however many rows its group has, and is combined map-side. Null latencies are left out.
    """
    return df.filter(F.col(latency_col).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col(latency_col).cast("bigint"), F.lit(k)).alias("sketch"))


def merged_percentiles(sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.5, 0.95, 0.99), k: int = SKETCH_K) -> DataFrame:
    """AG9: percentiles of any coarser grouping, from stored sketches alone; the rows are not read again.

    The rank of a result among the group's rows is within 1 % of the quantile asked for.
    """
    m = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("__s"))
    return m.select(*keys, "n", *[F.kll_sketch_get_quantile_bigint("__s", F.lit(float(q))).alias(f"p{q * 100:g}".replace(".", "_")) for q in quantiles])


def manifest_rows(df: DataFrame, batch_col: str, reason_col: str,
                  reasons: Sequence[str], fields: Sequence[str] = (), categories: Sequence[str] = ()) -> DataFrame:
    """AG8 receipt: counts per batch, one column per drop reason; for each of ``fields`` how many output rows hold its
    hash (flag ``hashed_<field>``) and how many input rows lost it for its length (flag ``oversized_<field>``), and for each of the analyzer's ``categories``
    how many were hashed for it (``category_<field>``), as ``hashed_<field>_<CATEGORY>``."""
    aggs = [F.count(F.lit(1)).alias("input_count"),
            F.count_if(F.col(reason_col).isNull()).alias("output_count")]
    aggs += [F.count_if(F.col(reason_col) == r).alias(f"dropped_{r}") for r in reasons]
    aggs += [F.count_if(F.col(reason_col).isNull() & F.col(f"hashed_{f}")).alias(f"hashed_{f}") for f in fields]
    aggs += [F.count_if(F.col(reason_col).isNull() & (F.col(f"category_{f}") == c)).alias(f"hashed_{f}_{c}") for f in fields for c in categories]
    aggs += [F.count_if(F.col(f"oversized_{f}")).alias(f"oversized_{f}") for f in fields]
    return df.groupBy(batch_col).agg(*aggs)
