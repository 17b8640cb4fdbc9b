import os

from pyspark.sql import functions as F

from tracefold.sources import sinks
from tracefold.sources import tables as T
from tracefold.streaming import live

SF = "/root/testdata/sf0.001"


def _run(df, scratch, name, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
           .option("checkpointLocation", os.path.join(scratch, "ck-" + name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def _stream_of(spark, df, scratch, name, per_trigger=1):
    """Files are written in arbitrary order; with one file per trigger, rows
    older than the watermark in later files are dropped as late."""
    path = os.path.join(scratch, name)
    df.repartition(3).write.parquet(path)
    return sinks.stream_records(spark, path, df.schema, max_files_per_trigger=per_trigger)


def test_streaming_gate_matches_batch(spark, scratch):
    rec = T.records(spark, SF)
    stream = _stream_of(spark, rec, scratch, "rec")
    key, rates = b"k", {"decision_summary": 0.5}
    attrs = [c for c in T.RECORD_ATTR_SPEC if c != "decision_id"]  # the record id is carried, not gated
    out = _run(live.gate_stream(stream, attrs, key, rates), scratch, "gated")
    batch = live.gate_stream(rec, attrs, key, rates)
    assert sorted(r.decision_id for r in out.collect()) == sorted(r.decision_id for r in batch.collect())


def test_streaming_dedupe_and_usage(spark, scratch):
    g = T.guard_events(spark, SF)
    dup = g.unionByName(g.filter(F.col("event_id") % 5 == 0))
    stream = _stream_of(spark, dup, scratch, "ge", per_trigger=None)
    out = _run(live.dedupe_stream(stream), scratch, "dedup")
    assert out.count() == g.count()
    rec = _stream_of(spark, T.records(spark, SF), scratch, "rec2", per_trigger=None)
    usage = _run(live.usage_stream(rec, "1 hour"), scratch, "usage")
    # append mode emits a window once the watermark (max event time - 60 s)
    # passes its end, so the newest window is still open when input ends
    r = T.records(spark, SF)
    mx = r.agg(F.max("ts")).first()[0]
    closed = r.filter(F.window("ts", "1 hour")["end"] <= F.lit(mx) - F.expr("INTERVAL 60 SECONDS")).count()
    assert usage.agg(F.sum("request_count")).first()[0] == closed


def test_rate_limit_stream(spark, scratch):
    rec = T.records(spark, SF).select("agent_id", "decision_id", "ts")
    stream = _stream_of(spark, rec, scratch, "rl", per_trigger=None)
    out = _run(live.rate_limit_stream(stream, limit=1, bucket_seconds=86400), scratch, "rl_out")
    per = out.groupBy("agent_id", "bucket").count()
    assert per.agg(F.max("count")).first()[0] == 1
    assert out.count() == rec.select("agent_id", F.to_date("ts")).distinct().count()


def test_escalation_stream_timers_and_conflicts(spark, scratch):
    esc = spark.createDataFrame(
        [("e1", "2024-01-01 00:00:00", "2024-01-01 04:00:00", "fail-closed"),
         ("e2", "2024-01-01 00:00:00", "2024-01-01 04:00:00", "fail-open"),
         ("e3", "2024-01-01 00:00:00", "2024-01-01 04:00:00", "defer")],
        "escalation_id string, requested_at string, deadline string, fallback string").select(
        "escalation_id", F.col("requested_at").cast("timestamp_ntz").alias("requested_at"),
        F.col("deadline").cast("timestamp_ntz").alias("deadline"), "fallback")
    rev = spark.createDataFrame(
        [("e1", "2024-01-01 01:00:00", "approve", "n1"), ("e1", "2024-01-01 02:00:00", "approve", "n2"),
         ("e1", "2024-01-01 03:00:00", "reject", "n3")],
        "escalation_id string, reviewed_at string, verdict string, nonce string").select(
        "escalation_id", F.col("reviewed_at").cast("timestamp_ntz").alias("reviewed_at"), "verdict", "nonce")
    late = spark.createDataFrame([("zz", "2024-01-02 12:00:00", "2024-01-02 16:00:00", "defer")],
                                 "escalation_id string, requested_at string, deadline string, fallback string").select(
        "escalation_id", F.col("requested_at").cast("timestamp_ntz").alias("requested_at"),
        F.col("deadline").cast("timestamp_ntz").alias("deadline"), "fallback")
    events = live.escalation_events(esc.unionByName(late), rev)
    path = os.path.join(scratch, "esc")
    events.filter(F.col("escalation_id") != "zz").coalesce(1).write.parquet(os.path.join(path, "a"))
    events.filter(F.col("escalation_id") == "zz").coalesce(1).write.parquet(os.path.join(path, "b"))
    stream = sinks.stream_records(spark, os.path.join(path, "*"), events.schema, max_files_per_trigger=1)
    out = {(r.escalation_id, r.outcome, r.verdict) for r in _run(live.escalation_stream(stream), scratch, "esc_out").collect()}
    assert ("e1", "accepted", "approve") in out and ("e1", "conflict", "reject") in out
    assert ("e2", "fallback_closed", "approve") in out and ("e3", "fallback_open", None) in out
    assert not any(o[0] == "e1" and o[1].startswith("fallback") for o in out)


def _in_batches(spark, frames, scratch, name):
    """A stream that delivers one frame per micro-batch, in order."""
    path = os.path.join(scratch, name)
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(path)
        for file in os.listdir(path):
            if file.endswith(".parquet"):
                at = os.path.join(path, file)
                if os.path.getmtime(at) > 1e9 + 1000:       # not given its place yet
                    os.utime(at, (1e9 + i, 1e9 + i))
    return sinks.stream_records(spark, path, frames[0].schema, max_files_per_trigger=1)


def _state_rows(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def _deliveries(spark, rows):
    return spark.createDataFrame(rows, "nonce string, reviewed_at string").withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp_ntz"))


def test_nonce_replay_stream_equals_twin(spark, scratch):
    """Sightings 0, 20 and 40 h apart: each starts the window anew, so all but the first are replays; 25 h is none."""
    from tracefold.operators import escalation
    rows = [("n1", "2024-01-01 00:00:00"), ("n1", "2024-01-01 00:00:00"), ("n1", "2024-01-01 20:00:00"), ("n1", "2024-01-02 16:00:00"),
            ("n2", "2024-01-01 01:00:00"), ("n2", "2024-01-02 02:00:01"), ("n3", "2024-01-02 01:00:00"), ("n3", "2024-01-03 01:00:00")]
    rows.sort(key=lambda r: r[1])
    twin = {r.nonce: (r.deliveries, r.rejected) for r in escalation.nonce_replays(_deliveries(spark, rows)).collect()}
    assert twin == {"n1": (4, 3), "n2": (2, 0), "n3": (2, 1)}
    flush = [("end", "2024-02-01 00:00:00"), ("end", "2024-03-01 00:00:00")]
    for name, size in (("one", 100), ("two", 2), ("each", 1)):
        frames = [_deliveries(spark, rows[i:i + size]) for i in range(0, len(rows), size)] + [_deliveries(spark, [r]) for r in flush]
        stream = live.nonce_replay_stream(_in_batches(spark, frames, scratch, "n_" + name))
        q = (stream.writeStream.format("memory").queryName("replay_" + name).outputMode("append")
             .option("checkpointLocation", os.path.join(scratch, "ck_" + name)).trigger(availableNow=True).start())
        q.awaitTermination()
        got = spark.table("replay_" + name).filter("nonce <> 'end'")
        assert {r.nonce: (r.n, r.x) for r in got.groupBy("nonce").agg(F.count("*").alias("n"), F.count_if("replayed").alias("x")).collect()} == twin
        assert {r.nonce: (r.n, r.x) for r in got.groupBy("nonce").agg(F.max("deliveries").alias("n"), F.max("rejected").alias("x")).collect()} == twin
        assert _state_rows(q) <= 1          # the last flush row's own


def test_late_rows_equal_twin_and_are_counted(spark, scratch):
    """Arrivals in 5-minute batches; the stream's late rows are the twin's, none reaches a window, and state counts them."""
    from tracefold.streaming import twins
    a = T.arrivals(spark, SF).select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "arrived_at").filter("event_id < 400").cache()
    # few batches: the same events over a shorter time, so that batches overlap
    t0 = a.agg(F.min("ts")).first()[0]
    shrink = lambda c: (F.lit(t0) + F.make_dt_interval(secs=F.floor((F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.lit(t0).cast("timestamp"))) / 2_000_000_00).cast("decimal(18,6)")))
    delay = (F.col("event_id") * 7919 % 600).cast("decimal(18,6)")
    a = a.select("event_id", shrink("ts").cast("timestamp_ntz").alias("ts")).withColumn("arrived_at", F.col("ts") + F.make_dt_interval(secs=delay)).cache()
    twin = twins.late_events(a, "ts", "arrived_at").cache()
    want = {r.event_id: r.late for r in twin.collect()}
    assert 0 < sum(want.values()) < len(want)
    frames = [a.join(twin.filter(F.col("batch") == b.batch).select("event_id"), "event_id") for b in twin.select("batch").distinct().orderBy("batch").collect()]
    marked = live.mark_late(_in_batches(spark, frames, scratch, "arr"), slots=4)
    out = os.path.join(scratch, "split")
    q = live.split_late(marked, out, os.path.join(scratch, "ck_split")).trigger(availableNow=True).start()
    q.awaitTermination()
    late = {r.event_id for r in spark.read.parquet(out + "/late").collect()}
    kept = spark.read.parquet(out + "/on_time")
    assert late == {i for i, x in want.items() if x} and {r.event_id for r in kept.collect()} == {i for i, x in want.items() if not x}
    # a window over the rows in time counts these and no other
    windows = _run(live.event_time(sinks.stream_records(spark, out + "/on_time/*", kept.drop("batch").schema), "ts").withWatermark("ts", "60 seconds")
                   .groupBy(F.window("ts", "1 minute")).count(), scratch, "win", mode="complete")
    assert windows.agg(F.sum("count")).first()[0] == len(want) - len(late)
    # what the state has counted
    again = live.mark_late(_in_batches(spark, frames, scratch, "arr2"), slots=4, salt=["event_id"])
    rows = _run(again, scratch, "marked")
    slot = F.pmod(F.xxhash64("event_id"), F.lit(4))
    assert rows.groupBy(slot).agg(F.max("late_so_far").alias("n")).agg(F.sum("n")).first()[0] == len(late)


def test_ordered_fold_stream_equals_twin(spark, scratch):
    """Events of many decisions, shuffled within the delay: released in order, the last row is the twin's, state goes to zero."""
    import random

    from tracefold.streaming import twins
    rnd = random.Random(6)
    rows = [(d, d * 100 + i, f"2024-01-01 00:{i:02d}:{rnd.choice((0, 0, 30)):02d}", rnd.random() < 0.5, f"rail:{rnd.randint(0, 3)}") for d in range(12) for i in range(20)]
    df = spark.createDataFrame(rows, "decision_id long, event_id long, ts string, blocked boolean, policy string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    twin = {r.decision_id: tuple(r)[1:] for r in twins.ordered_fold(df, ["decision_id"], ["ts", "event_id"], ["blocked", "policy"]).collect()}
    for name, size in (("a", 17), ("b", 60), ("c", 240)):
        arrival = sorted(rows, key=lambda r: int(r[2][14:16]) + rnd.uniform(0, 4))      # up to four minutes out of order
        frames = [arrival[i:i + size] for i in range(0, len(arrival), size)] + [[(999, 1, "2024-01-01 03:00:00", True, "x")], [(999, 2, "2024-01-01 06:00:00", True, "x")]]
        frames = [spark.createDataFrame(f, "decision_id long, event_id long, ts string, blocked boolean, policy string").withColumn("ts", F.col("ts").cast("timestamp_ntz")) for f in frames]
        stream = live.ordered_fold_stream(_in_batches(spark, frames, scratch, "of_" + name), ["blocked", "policy"], delay="6 minutes")
        q = (stream.writeStream.format("memory").queryName("fold_" + name).outputMode("append")
             .option("checkpointLocation", os.path.join(scratch, "ck_of_" + name)).trigger(availableNow=True).start())
        q.awaitTermination()
        got = spark.table("fold_" + name).filter("decision_id < 999").collect()
        assert len(got) == len(rows)
        order = {}
        for r in sorted(got, key=lambda r: (r.decision_id, r.n_events)):
            order.setdefault(r.decision_id, []).append(r)
        for d, rs in order.items():
            assert [(r.ts, r.event_id) for r in rs] == sorted((r.ts, r.event_id) for r in rs) and [r.n_events for r in rs] == list(range(1, 21))
            end = rs[-1]
            assert (end.n_events, end.first_event, end.last_event, end.last_blocked, end.last_policy) == twin[d]
        assert _state_rows(q) <= 1          # the flush decision's own
