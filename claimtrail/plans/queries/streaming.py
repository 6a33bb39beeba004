"""Registered queries, group K (streaming): K1_stream_counters, K6_case_sessions, K2_stream_dedupe, K3_stream_states, K4_stream_publish, K5_stream_validate, K7_stream_chain, K1_stream_counters_sliding."""

from ._shared import *  # noqa: F401,F403
from ._shared import register  # noqa: F401


#: A replay in which events come up to 12 hours late, closed by a heartbeat.
_LATE = {"jitter_ms": 12 * 3_600_000, "key": "event_id", "hold_ms": 2 * 86_400_000}


@register("K1_stream_counters", _K1_SQL)
def q_k1(spark, sf_dir):
    """Events replayed as 4 time slices; daily counts per event type,
    emitted as windows close."""
    out = _replayed_events(spark, sf_dir, "k1", lambda stream, out, ckpt: streams.run_to_folder(
        streams.stream_counters(stream, "ts", ["event_type"], "1 day", delay="1 hour"), out, ckpt, state_partitions=_state_parts(spark)))
    return streams.read_folder(spark, out, "window_start long, window_end long, event_type string, n long")


@register("K6_case_sessions", _K6_SQL)
def q_k6(spark, sf_dir):
    """Activity sessions per user (6 hour gap), emitted once closed."""
    out = _replayed_events(spark, sf_dir, "k6", lambda stream, out, ckpt: streams.run_to_folder(
        streams.case_sessions(stream, "ts", "user_id", "6 hours", "1 hour"), out, ckpt, state_partitions=_state_parts(spark)))
    return streams.read_folder(spark, out, "user_id long, session_start long, session_end long, n long")


@register("K2_stream_dedupe", """
SELECT DISTINCT user_id, event_type FROM events
""")
def q_k2(spark, sf_dir):
    """One row per (user, event type) over the whole replay (delay covers
    the table's time span)."""
    out = _replayed_events(spark, sf_dir, "k2", lambda stream, out, ckpt: streams.run_to_folder(
        streams.stream_dedupe(stream, "ts", ["user_id", "event_type"], "60 days"), out, ckpt, state_partitions=_state_parts(spark)))
    return streams.read_folder(spark, out).select("user_id", "event_type")


@register("K3_stream_states", f"""
WITH RECURSIVE {_FOLD_SQL}
SELECT case_id, arg_max(state, seq) AS state, CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS accepted,
       CAST(sum(CASE WHEN accepted THEN 0 ELSE 1 END) AS BIGINT) AS rejected
FROM folded GROUP BY case_id
""")
def q_k3(spark, sf_dir):
    """The workflow state machine per user.  Events arrive up to 12 hours late and settle a day later, long
    before the end of the replay; a heartbeat settles the last ones.  The final states equal the batch fold (G4)."""
    def run(stream, out, ckpt):
        tr = stream.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"),
                           F.col("event_id").alias("seq"), fixtures._event_state().alias("to_state"), "ts")
        streams.run_to_folder(streams.settled_states(tr, delay="1 day"), out, ckpt, state_partitions=_state_parts(spark), rocksdb=True)

    out = _replayed_events(spark, sf_dir, "k3", run, **_LATE)
    return streams.settled_finals(streams.read_folder(spark, out))


@register("K3_settled_states", f"""
WITH RECURSIVE {_FOLD_SQL}
SELECT case_id, seq, to_state, from_state, state, accepted FROM folded
""")
def q_k3s(spark, sf_dir):
    """Each event's transition, emitted once when it settles: the rows of the batch fold."""
    def run(stream, out, ckpt):
        tr = stream.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"),
                           F.col("event_id").alias("seq"), fixtures._event_state().alias("to_state"), "ts")
        streams.run_to_folder(streams.settled_states(tr, delay="1 day"), out, ckpt, state_partitions=_state_parts(spark), rocksdb=True)

    out = _replayed_events(spark, sf_dir, "k3s", run, **_LATE)
    return streams.read_folder(spark, out).select("case_id", "seq", "to_state", "from_state", "state", "accepted")


@register("K4_stream_publish", f"""
WITH {_SNAPSHOT}
SELECT DISTINCT s.case_id, s.case_fingerprint || ':' || s.assessment_fp AS idempotency_key
FROM snap s JOIN events e ON s.case_id = 'user-' || CAST(e.user_id AS VARCHAR)
WHERE s.state = 'approved' AND e.event_type IN ('purchase', 'click')
""")
def q_k4(spark, sf_dir):
    """Publish requests (purchase and click events) streamed against the
    state snapshot; each approved case's key is exported exactly once."""
    snapshot = fixtures.state_snapshot(spark, sf_dir)

    def run(stream, out, ckpt):
        rq = stream.where(F.col("event_type").isin("purchase", "click")).select(
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"), F.col("event_id").alias("seq"))
        streams.stream_publish(rq, snapshot, out, ckpt, state_partitions=_state_parts(spark))

    out = _replayed_events(spark, sf_dir, "k4", run)
    return streams.read_folder(spark, out, "case_id string, idempotency_key string").select(
        "case_id", "idempotency_key")


_K5_SQL = f"""
WITH {_CITES}, {O.CONV_SOURCES}
SELECT cit.case_id, cit.cpos, cit.source_id,
       CASE WHEN src.text IS NULL THEN 'unknown_source'
            WHEN {O.blank('cit.quote')} OR NOT contains(src.text, cit.quote) THEN 'unresolved' ELSE 'ok' END AS status
FROM cit LEFT JOIN src ON src.case_id = cit.case_id AND src.source_id = cit.source_id
"""


def _streamed_citations(spark, sf_dir, name):
    """Conversation citations written as files: (folder, schema, output, checkpoint)."""
    inp, out, ckpt = streams.new_run_paths(spark, name)
    c = fixtures.table(spark, sf_dir, "conversations")
    cites = c.select(
        F.col("conv_id").cast("string").alias("case_id"), F.col("turn").alias("cpos"),
        F.when(F.col("turn") % 3 == 0, F.col("turn").cast("string")).when(F.col("turn") % 3 == 1, F.lit("99"))
        .otherwise((F.col("turn") - 1).cast("string")).alias("source_id"),
        F.substring("text", 3, 25).alias("quote"),
        F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("conv_id") * 60_000 + F.col("turn") * 1000).alias("ts"))
    cites.repartition(4).write.parquet(inp)
    return inp, cites.schema, out, ckpt


@register("K5_stream_validate", _K5_SQL)
def q_k5(spark, sf_dir):
    """Citations streamed from replayed conversation files, grounded against
    the static conversation sources (stream-static join)."""
    inp, schema, out, ckpt = _streamed_citations(spark, sf_dir, "k5")
    _, sources = fixtures.conversation_cases(spark, sf_dir)
    grounded = streams.stream_validate(streams.stream_files(spark, inp, schema).drop("ts"), sources)
    streams.run_to_folder(grounded, out, ckpt, state_partitions=_state_parts(spark))
    return streams.read_folder(spark, out).select("case_id", "cpos", "source_id", "status")


@register("K5_batch_validate", _K5_SQL)
def q_k5b(spark, sf_dir):
    """The same with every micro-batch grounded as a static frame."""
    inp, schema, out, ckpt = _streamed_citations(spark, sf_dir, "k5b")
    _, sources = fixtures.conversation_cases(spark, sf_dir)
    streams.validate_in_batches(streams.stream_files(spark, inp, schema).drop("ts"), sources, out, ckpt, state_partitions=_state_parts(spark))
    return streams.read_folder(spark, out).select("case_id", "cpos", "source_id", "status")


@register("K5_late_sources", _K5_SQL)
def q_k5l(spark, sf_dir):
    """Citations and their sources both streamed; sources come ten minutes after the citations in
    event time, and heartbeats on both sides close the last citations that never get one."""
    inp, schema, out, ckpt = _streamed_citations(spark, sf_dir, "k5l")
    _, sources = fixtures.conversation_cases(spark, sf_dir)
    timed = sources.select("case_id", "source_id", "text", F.timestamp_millis(
        F.lit(1_700_000_600_000) + F.col("case_id").cast("long") * 60_000 + F.col("source_id").cast("long") * 1000).alias("ts"))
    timed.repartition(4).write.parquet(f"{inp}-sources")
    run = lambda: streams.run_to_folder(streams.stream_validate_late_sources(
        streams.stream_files(spark, inp, schema, None), streams.stream_files(spark, f"{inp}-sources", timed.schema, None), "30 minutes"),
        out, ckpt, state_partitions=_state_parts(spark))
    run()
    far = F.timestamp_millis(F.lit(1_900_000_000_000))
    for folder, kind in ((inp, schema), (f"{inp}-sources", timed.schema)):
        spark.range(1).select(*[(far if f.name == "ts" else F.lit("") if f.name != "cpos" else F.lit(-1)).cast(f.dataType).alias(f.name)
                                for f in kind.fields]).write.mode("append").parquet(folder)
    run()
    return streams.read_folder(spark, out).where(F.col("cpos") >= 0).select("case_id", "cpos", "source_id", "status")


@register("K7_stream_chain", f"""
WITH RECURSIVE {O.AUDIT}
SELECT chain, seq, prev AS previous_hash, h AS event_hash FROM chainh
""")
def q_k7(spark, sf_dir):
    """Audit rows that arrive up to 12 hours late, hash-chained per user as they settle a day later; a heartbeat
    settles the last ones.  Equals the batch chain (B3)."""
    inp, out, ckpt = streams.new_run_paths(spark, "k7")
    audit = fixtures.audit_events(spark, sf_dir).withColumn("ts", F.timestamp_micros("ts_us"))
    run = lambda: streams.run_to_folder(streams.settled_chain(
        streams.stream_files(spark, inp, audit.schema, None), delay="1 day"), out, ckpt, state_partitions=_state_parts(spark), rocksdb=True)
    streams.replay(audit, "ts", inp, run, **_LATE | {"key": "seq"})
    return streams.read_folder(spark, out)


@register("K1_stream_counters_sliding", """
WITH e AS (SELECT epoch_us(ts) AS t, event_type FROM events),
  wm AS (SELECT max(t) - 3600000000 AS wm FROM e),
  s AS (SELECT (t // 43200000000) * 43200000000 AS b, event_type FROM e),
  w AS (SELECT b - k * 43200000000 AS ws, event_type FROM s, (SELECT unnest([0, 1]) AS k) ks),
  c AS (SELECT ws, event_type, count(*) AS n FROM w GROUP BY ALL)
SELECT ws AS window_start, ws + 86400000000 AS window_end, event_type, n FROM c, wm
WHERE ws + 86400000000 <= wm.wm
""")
def q_k1s(spark, sf_dir):
    """Sliding one-day windows every 12 hours, per event type."""
    out = _replayed_events(spark, sf_dir, "k1s", lambda stream, out, ckpt: streams.run_to_folder(
        streams.stream_counters(stream, "ts", ["event_type"], "1 day", "12 hours", "1 hour"), out, ckpt, state_partitions=_state_parts(spark)))
    return streams.read_folder(spark, out, "window_start long, window_end long, event_type string, n long")
