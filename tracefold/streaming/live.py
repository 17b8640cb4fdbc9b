"""Structured Streaming operators (SM1-SM11).

Stateless gates (SM1) are the batch column expressions applied to a
streaming frame. Event-time operators use watermarks; per-key state (rate
counters, escalation timers, first verdicts) lives in
``applyInPandasWithState``, whose function sees a key's rows as an iterator
of Arrow batches, so one hot key never has to fit in memory at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracefold import constants as C
from tracefold.operators import accounting, gate_pipeline


def event_time(df: DataFrame, ts_col: str) -> DataFrame:
    """Watermarks need a TIMESTAMP column; wall-clock TIMESTAMP_NTZ values are
    read as UTC instants (the session time zone is UTC)."""
    if dict(df.dtypes).get(ts_col) == "timestamp_ntz":
        return df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return df


def gate_stream(df: DataFrame, attr_cols: Sequence[str], key: bytes | str, rates: dict,
                predicate: str | None = None, extra=None, redact_key: bytes | str | None = None,
                skip: Sequence[str] = ()) -> DataFrame:
    """SM1: allowlist -> redaction -> policy -> sampler on an unbounded stream
    (stateless); redaction takes part if it has a key."""
    return gate_pipeline.gated(df, attr_cols, key, rates, predicate, redact_key, skip, extra)


def late_buffer(df: DataFrame, ts_col: str = "ts", delay: str = C.LATE_EVENT_BUFFER) -> DataFrame:
    """The watermark alone, for stateful operators that drop late rows by themselves."""
    return event_time(df, ts_col).withWatermark(ts_col, delay)


#: Slots that rows are dealt to while their lateness is decided; each holds two counters.
LATE_SLOTS = 64


def _late_fn(ts_col: str, columns: list[str]):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, dropped = state.get if state.exists else (0, 0)
        mark = pd.Timestamp(max(state.getCurrentWatermarkMs(), 0), unit="ms")
        for pdf in pdfs:
            late = pdf[ts_col] < mark
            seen, dropped = seen + len(pdf), dropped + int(late.sum())
            yield pdf[columns].assign(late=late, watermark=mark, late_so_far=dropped)
        state.update((seen, dropped))
    return fn


def mark_late(df: DataFrame, ts_col: str = "ts", delay: str = C.LATE_EVENT_BUFFER, slots: int = LATE_SLOTS,
              salt: Sequence[str] | None = None) -> DataFrame:
    """SM2: every row with ``late`` (its event time lies before the watermark of its micro-batch, i.e. more than
    ``delay`` before the latest event time of all earlier micro-batches), that ``watermark``, and ``late_so_far``.

    A window in append mode would open a new window for a row that comes too late and emit it at once; here lateness is
    decided in state before any window, so the rows to discard can be counted and kept (:func:`split_late`).
    Rows are dealt to ``slots`` by a hash of ``salt`` (all columns), so no key is hot and state stays at two
    counters a slot. ``late_so_far`` counts the late rows of the row's slot.
    """
    d = event_time(df, ts_col).withWatermark(ts_col, delay)
    out = T.StructType([*d.schema.fields, T.StructField("late", T.BooleanType()), T.StructField("watermark", T.TimestampType()),
                        T.StructField("late_so_far", T.LongType())])
    slot = F.pmod(F.xxhash64(*(salt or d.columns)), F.lit(slots)).cast("int")
    return d.withColumn("__slot", slot).groupBy("__slot").applyInPandasWithState(
        _late_fn(ts_col, d.columns), out, "seen long, dropped long", "append", GroupStateTimeout.NoTimeout)


def split_late(marked: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """SM2: write the rows of :func:`mark_late` that are in time to ``path/on_time`` and the others to ``path/late``.

    Each micro-batch replaces its own folders, so one that is repeated after a failure counts once. A windowed
    stream over ``path/on_time`` sees exactly the rows to keep.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        for name, part in (("on_time", rows.filter("NOT late")), ("late", rows.filter("late"))):
            part.drop("late", "watermark", "late_so_far").write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        rows.unpersist()

    return marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def dedupe_stream(df: DataFrame, keys: Sequence[str] = ("decision_id", "event_id"), ts_col: str = "ts",
                  delay: str = C.LATE_EVENT_BUFFER) -> DataFrame:
    """SM3: each ``(decision_id, event_id)`` once while within the watermark."""
    return event_time(df, ts_col).withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(list(keys))


REPLAY_OUT = "nonce string, at timestamp, replayed boolean, deliveries long, rejected long"
REPLAY_STATE = "last_us long, deliveries long, rejected long"


def _replay_fn(window_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, deliveries, rejected = state.get if state.exists else (None, 0, 0)
        # a batch of one nonce may come in several frames: its times are 8 bytes each and put in order together
        times = np.sort(np.concatenate([pdf["at"].to_numpy().astype("datetime64[us]").astype(np.int64) for pdf in pdfs]))
        before = np.concatenate([[times[0] - window_us - 1 if last is None else last], times[:-1]])
        replayed = times - before <= window_us
        count = np.cumsum(replayed) + rejected
        yield pd.DataFrame({"nonce": key[0], "at": times.astype("datetime64[us]"), "replayed": replayed,
                            "deliveries": np.arange(deliveries + 1, deliveries + 1 + len(times)), "rejected": count})
        last = int(max(times[-1], times[-1] if last is None else last))
        state.update((last, deliveries + len(times), int(count[-1])))
        # forgotten once no delivery that is still in time can lie within the window of the last one
        state.setTimeoutTimestamp(max((last + window_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    return fn


def nonce_replay_stream(df: DataFrame, ts_col: str = "reviewed_at", window: str = C.NONCE_WINDOW, delay: str = "1 hour") -> DataFrame:
    """SM4: every delivery with ``replayed``: its nonce was delivered in the ``window`` before, accepted or not.

    State is the time of a nonce's last delivery, so each sighting starts the window anew, as in the batch twin
    (``escalation.nonce_replays``). It is released when the watermark (``delay`` behind) is a window past it. Deliveries
    that come in more than ``delay`` late are dropped by the watermark. ``deliveries`` and ``rejected`` count so far.
    """
    micros = int(pd.Timedelta(window).value // 1000)
    d = event_time(df, ts_col).withWatermark(ts_col, delay).select("nonce", F.col(ts_col).alias("at")).filter("nonce IS NOT NULL")
    return d.groupBy("nonce").applyInPandasWithState(_replay_fn(micros), REPLAY_OUT, REPLAY_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# --------------------------------------------------------------------------- SM11
def _fold_fn(fields: list[str], idle_ms: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last, kept, held = (json.loads(state.get[0]) if state.exists else (0, None, None, {}, []))
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                held.append([_us(r.ts), int(r.event_id), {f: _plain(getattr(r, f)) for f in fields}])
        held.sort(key=lambda e: e[:2])
        mark = state.getCurrentWatermarkMs() * 1000
        ready = [e for e in held if e[0] < mark]
        held = held[len(ready):]
        rows = []
        for us, event, values in ready:
            n, first, last = n + 1, event if first is None else first, event
            kept = {f: kept.get(f) if values[f] is None else values[f] for f in fields}
            rows.append((key[0], n, pd.Timestamp(us, unit="us"), event, first, last, *[kept[f] for f in fields]))
        if rows:
            yield pd.DataFrame(rows, columns=["decision_id", "n_events", "ts", "event_id", "first_event", "last_event", *[f"last_{f}" for f in fields]])
        newest = max([e[0] for e in ready[-1:]] + ([state.get[1]] if state.exists else [0]))
        if not held and mark > newest + idle_ms * 1000:
            state.remove()                  # nothing is buffered and the decision has been quiet
            return
        state.update((json.dumps([n, first, last, kept, held]), newest))
        wake = held[0][0] // 1000 + 1 if held else newest // 1000 + idle_ms + 1
        state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
    return fn


def _plain(v):
    return None if v is None or (not isinstance(v, str) and pd.isna(v)) else v.item() if hasattr(v, "item") else v


def ordered_fold_stream(df: DataFrame, fields: Sequence[str], delay: str = C.LATE_EVENT_BUFFER, idle: str = "1 hour",
                        ts_col: str = "ts") -> DataFrame:
    """SM11: a decision's events applied in the order of ``(ts, event_id)``, whatever order they arrive in.

    Events (``decision_id, event_id, ts`` and ``fields``) wait in a buffer per decision until the watermark, ``delay``
    behind the latest event time, has passed them; then they are released in order, one row each, with the fold so far:
    the number of events, the first and the last one, and the last known value of each field. The last row
    of a decision is what the batch twin (``twins.ordered_fold``) gives for it, if no value is null. An event that comes in
    behind the watermark is dropped, as its place in the order is gone (see :func:`mark_late`). A decision with nothing
    buffered is forgotten once it has been quiet for ``idle``. The buffer holds a decision's events of the last ``delay`` only.
    """
    fields = list(fields)
    d = event_time(df, ts_col).withColumnRenamed(ts_col, "ts").withWatermark("ts", delay).select("decision_id", "event_id", "ts", *fields)
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    out = "decision_id bigint, n_events bigint, ts timestamp, event_id bigint, first_event bigint, last_event bigint" + "".join(f", last_{f} {kinds[f]}" for f in fields)
    return d.groupBy("decision_id").applyInPandasWithState(
        _fold_fn(fields, int(pd.Timedelta(idle).value // 1_000_000)), out, "held string, newest long", "append", GroupStateTimeout.EventTimeTimeout)


def usage_stream(df: DataFrame, window: str = "5 minutes", keys: Sequence[str] = ("tenant_id",),
                 ts_col: str = "ts", delay: str = C.LATE_EVENT_BUFFER) -> DataFrame:
    """SM5: tumbling-window usage emitted once per window (append mode)."""
    return accounting.usage_by_window(event_time(df, ts_col).withWatermark(ts_col, delay), window, keys=keys,
                                      ts=ts_col)


# --------------------------------------------------------------------------- SM6
RATE_OUT = "agent_id string, decision_id long, ts timestamp, bucket long, seq long"
RATE_STATE = "n long"


def _rate_fn(limit: int, bucket_seconds: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = int(key[1])
        (n,) = state.get if state.exists else (0,)
        for pdf in pdfs:
            if n >= limit:
                continue
            pdf = pdf.sort_values(["ts", "decision_id"]).head(limit - n)
            out = pdf.assign(seq=range(n + 1, n + 1 + len(pdf)))
            n += len(pdf)
            yield out[["agent_id", "decision_id", "ts", "bucket", "seq"]]
        state.update((n,))
        # the counter is dropped once the watermark passes the bucket's end
        # (late rows can leave that end behind the watermark already)
        state.setTimeoutTimestamp(max((bucket + 1) * bucket_seconds * 1000, state.getCurrentWatermarkMs() + 1))
    return fn


def rate_limit_stream(df: DataFrame, limit: int = C.EGRESS_RATE_LIMIT_PER_S, bucket_seconds: int = 1,
                      ts_col: str = "ts", delay: str = C.LATE_EVENT_BUFFER) -> DataFrame:
    """SM6: at most ``limit`` events per agent and event-time bucket pass.

    State is one counter per (agent, bucket), so the cap is exact in any
    arrival order; each counter is released by an event-time timeout once
    the watermark passes its bucket. Which rows pass follows the arrival
    order of Arrow batches; inside one batch the earliest rows do.
    """
    d = event_time(df.select("agent_id", "decision_id", ts_col), ts_col).withWatermark(ts_col, delay)
    d = d.withColumnRenamed(ts_col, "ts").withColumn(
        "bucket", F.floor(F.unix_micros("ts") / F.lit(bucket_seconds * 1_000_000)).cast("bigint"))
    return d.groupBy("agent_id", "bucket").applyInPandasWithState(
        _rate_fn(limit, bucket_seconds), RATE_OUT, RATE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# --------------------------------------------------------------------------- SM7 / SM8
ESC_EVENT = ("escalation_id string, kind string, at timestamp_ntz, deadline timestamp_ntz, "
             "fallback string, verdict string, nonce string")
ESC_OUT = "escalation_id string, outcome string, verdict string, reviewer_id string, at timestamp"
ESC_STATE = "deadline_us long, fallback string, status string, first_verdict string"
#: How long a closed escalation is remembered, to tell repeats and conflicts.
ESC_RELEASE_MS = C.STALE_VERDICT_DAYS * 86_400_000


def _us(t) -> int:
    return int(pd.Timestamp(t).value // 1000)


def _esc_fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    esc_id = key[0]
    deadline_us, fallback, status, first = state.get if state.exists else (None, None, None, None)
    rows: list[tuple] = []

    def time_out() -> None:
        nonlocal status, first
        verdict = {"fail-closed": "reject", "fail-open": "approve"}.get(fallback)
        rows.append((esc_id, "fallback_open" if verdict is None else "fallback_closed", verdict, C.TIMEOUT_REVIEWER, pd.Timestamp(deadline_us, unit="us")))
        status, first = ("deferred", None) if verdict is None else ("closed", verdict)

    if state.hasTimedOut:
        if status != "open":                    # closed long ago, or deferred and never answered
            state.remove()
            return
        time_out()
    else:
        opened = None
        earliest: dict[str, tuple] = {}         # verdict -> its first (time, nonce): as many as there are verdicts
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                if r.kind == "open" and not pd.isna(r.deadline):
                    opened = min(opened or (r.at, r.deadline, r.fallback), (r.at, r.deadline, r.fallback))
                elif r.kind == "verdict" and r.verdict is not None:
                    at = (r.at, r.nonce or "")
                    earliest[r.verdict] = min(earliest.get(r.verdict, at), at)
        if status is None and opened is not None:
            deadline_us, fallback, status = _us(opened[1]), opened[2], "open"
        for verdict, (at, _) in sorted(earliest.items(), key=lambda x: x[1]):
            if status == "open" and fallback != "defer" and _us(at) > deadline_us:
                time_out()
            if status is None:
                rows.append((esc_id, "no_open_escalation", verdict, None, at))
            elif status in ("open", "deferred"):
                status, first = "closed", verdict
                rows.append((esc_id, "accepted", verdict, None, at))
            elif verdict != first:
                rows.append((esc_id, "conflict", verdict, None, at))
    if status is not None:
        state.update((deadline_us, fallback, status, first))
        wait = deadline_us // 1000 if status == "open" else max(deadline_us // 1000, state.getCurrentWatermarkMs()) + ESC_RELEASE_MS
        # a time that the watermark has passed can't be set
        state.setTimeoutTimestamp(max(wait, state.getCurrentWatermarkMs() + 1))
    if rows:
        yield pd.DataFrame(rows, columns=["escalation_id", "outcome", "verdict", "reviewer_id", "at"])


def escalation_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """SM7 + SM8: keyed escalation state with an event-time timer at the
    deadline. Events are qualified verdicts (see ``qualified_reviews``).

    The first verdict of a micro-batch in the order of time and nonce is
    accepted if the escalation is open, a repeat of it is ignored, a
    different one is a conflict (one row per verdict and micro-batch). When
    the watermark passes the deadline with no verdict, or a later verdict
    comes first, the profile fallback is emitted with the timeout reviewer;
    ``fail-closed`` and ``fail-open`` close the escalation, ``defer`` leaves
    it to be answered later. A verdict whose escalation was never opened is
    rejected. Closed and deferred escalations are forgotten after
    ``ESC_RELEASE_MS``, so state does not grow."""
    return event_time(events, "at").withWatermark("at", delay).groupBy("escalation_id").applyInPandasWithState(
        _esc_fn, ESC_OUT, ESC_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def escalation_events(escalations: DataFrame, reviews: DataFrame) -> DataFrame:
    """Open and verdict events in the one shape ``escalation_stream`` reads."""
    o = escalations.select("escalation_id", F.lit("open").alias("kind"), F.col("requested_at").alias("at"),
                           "deadline", "fallback", F.lit(None).cast("string").alias("verdict"),
                           F.lit(None).cast("string").alias("nonce"))
    v = reviews.select("escalation_id", F.lit("verdict").alias("kind"), F.col("reviewed_at").alias("at"),
                       F.lit(None).cast("timestamp_ntz").alias("deadline"), F.lit(None).cast("string").alias("fallback"),
                       "verdict", "nonce")
    return o.unionByName(v)
