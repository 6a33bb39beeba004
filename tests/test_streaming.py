"""K1-K7: streams replayed from files (no sockets); late data needs at least
three micro-batches because lateness is judged against the previous batch's
watermark."""

import datetime as dt

from pyspark.sql import functions as F

from claimtrail.streaming import streams

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1, 1, 0, 0)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def _write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)


def test_late_rows_dropped_after_watermark(spark, tmp_path):
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    _write(spark, f"{inp}/b1", [(d * 10 + i, T0 + d * DAY, i, "view") for d in range(5) for i in range(10)])
    _write(spark, f"{inp}/b2", [(100 + d * 10 + i, T0 + d * DAY, i, "view") for d in range(5, 10) for i in range(10)])
    _write(spark, f"{inp}/b3", [(999, T0, 1, "view")])          # older than the watermark: late
    stream = streams.stream_files(spark, inp, spark.createDataFrame([], SCHEMA).schema)
    streams.run_to_folder(streams.stream_counters(stream, "ts", ["event_type"], "1 day", delay="1 hour"), out, ck)
    got = {r.window_start: r.n for r in streams.read_folder(spark, out).collect()}
    first = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    assert got[first] == 10                       # the late row was not counted
    assert len(got) == 9                          # the last day's window is still open


def test_exactly_once_publish_on_replay(spark, tmp_path):
    inp, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write(spark, f"{inp}/b1", [(i, T0, i % 3, "purchase") for i in range(6)])
    _write(spark, f"{inp}/b2", [(10 + i, T0 + DAY, i % 3, "purchase") for i in range(6)])
    state = spark.createDataFrame([("user-0", "f0", "approved", "a0"), ("user-1", "f1", "published", "a1"),
                                   ("user-2", "f2", "approved", "a2")],
                                  "case_id string, case_fingerprint string, state string, assessment_fp string")
    schema = spark.createDataFrame([], SCHEMA).schema
    for run in range(2):                          # the second run replays everything from a fresh checkpoint
        stream = streams.stream_files(spark, inp, schema)
        rq = stream.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"),
                           F.col("event_id").alias("seq"))
        streams.stream_publish(rq, state, out, str(tmp_path / f"ck{run}"))
    keys = [r.idempotency_key for r in spark.read.parquet(out).collect()]
    assert sorted(keys) == ["f0:a0", "f2:a2"]


def test_stream_states_match_batch_fold(spark, tmp_path):
    from claimtrail.operators import workflow
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    seq = [("signup", 0), ("view", 1), ("click", 2), ("click", 3), ("purchase", 4), ("error", 5)]
    rows = [(s, T0 + s * DAY, u, e) for u in range(3) for e, s in seq if not (u == 1 and e == "view")]
    _write(spark, f"{inp}/b1", [r for r in rows if r[0] < 3])
    _write(spark, f"{inp}/b2", [r for r in rows if r[0] >= 3])
    stream = streams.stream_files(spark, inp, spark.createDataFrame([], SCHEMA).schema)
    m = {"signup": "received", "view": "pending_approval", "click": "approved", "purchase": "published",
         "error": "failed"}
    to_state = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("event_type")]
    tr = stream.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"),
                       F.col("event_id").alias("seq"), to_state.alias("to_state"), "ts")
    streams.run_to_folder(streams.stream_states(tr), out, ck, mode="update")
    got = {r.case_id: (r.state, r.accepted, r.rejected) for r in streams.latest_states(streams.read_folder(spark, out)).collect()}
    batch = spark.createDataFrame(rows, SCHEMA).select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"), F.col("event_id").alias("seq"),
        F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("event_type")].alias("to_state"))
    want = {r.case_id: (r.state, r.accepted, r.rejected)
            for r in workflow.final_states(workflow.fold_states(batch)).collect()}
    assert got == want and got["user-0"][0] == "published" and got["user-1"][0] == "failed"


def test_stale_cases_time_out(spark, tmp_path):
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    _write(spark, f"{inp}/b1", [(1, T0, 1, "signup"), (2, T0, 2, "signup")])
    _write(spark, f"{inp}/b2", [(3, T0 + 10 * DAY, 2, "view")])
    _write(spark, f"{inp}/b3", [(4, T0 + 20 * DAY, 2, "click")])
    stream = streams.stream_files(spark, inp, spark.createDataFrame([], SCHEMA).schema)
    m = {"signup": "received", "view": "pending_approval", "click": "approved"}
    to_state = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("event_type")]
    tr = stream.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"),
                       F.col("event_id").alias("seq"), to_state.alias("to_state"), "ts")
    streams.run_to_folder(streams.stream_states(tr, delay="1 hour", stale_after_ms=2 * 86_400_000), out, ck,
                          mode="update")
    rows = streams.read_folder(spark, out).collect()
    stale = {r.case_id for r in rows if r.stale}
    assert "user-1" in stale                         # no event for 10 days: timed out
    final = {r.case_id: r.state for r in streams.latest_states(streams.read_folder(spark, out)).collect()}
    assert final["user-2"] == "approved" and final["user-1"] == "received"


def test_out_of_order_batches(spark, tmp_path):
    """Batch 1 brings seq 0 and 2, batch 2 brings seq 1: states and chain equal the ordered ones."""
    from claimtrail.operators import chain
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    steps = ["received", "pending_approval", "approved"]
    schema = "case_id string, seq long, to_state string, ts timestamp_ntz"
    rows = [("c", i, steps[i], T0 + i * dt.timedelta(hours=1)) for i in range(3)]
    spark.createDataFrame([rows[0], rows[2]], schema).coalesce(1).write.parquet(f"{inp}/b1")
    spark.createDataFrame([rows[1]], schema).coalesce(1).write.parquet(f"{inp}/b2")
    stream = streams.stream_files(spark, inp, spark.createDataFrame([], schema).schema)
    streams.run_to_folder(streams.stream_states(stream), out, ck, mode="update")
    r = streams.latest_states(streams.read_folder(spark, out)).first()
    assert (r.state, r.accepted, r.rejected) == ("approved", 3, 0)

    inp, out, ck = (str(tmp_path / f"chain-{x}") for x in ("in", "out", "ck"))
    events = spark.createDataFrame([(1, i, i * 1000, "e", "c", {"k": str(i)}) for i in range(5)],
                                   "chain long, seq long, ts_us long, event string, case_id string, details map<string,string>")
    timed = events.withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(seq as int))"))
    for b, keep in (("b1", [0, 3]), ("b2", [1, 4]), ("b3", [2])):
        timed.where(F.col("seq").isin(keep)).coalesce(1).write.parquet(f"{inp}/{b}")
    streams.run_to_folder(streams.stream_chain(streams.stream_files(spark, inp, timed.schema)), out, ck, mode="update")
    got = {(r.seq, r.previous_hash, r.event_hash) for r in streams.latest_chain(streams.read_folder(spark, out)).collect()}
    assert got == {(r.seq, r.previous_hash, r.event_hash) for r in chain.chain_append(events).collect()}


def test_a_stale_case_can_still_be_approved(spark, tmp_path):
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "case_id string, seq long, to_state string, ts timestamp_ntz"
    batches = [[("c", 1, "received", T0), ("c", 2, "pending_approval", T0), ("d", 1, "received", T0)],
               [("d", 2, "pending_approval", T0 + 10 * DAY)], [("d", 3, "approved", T0 + 20 * DAY)],
               [("c", 3, "approved", T0 + 21 * DAY)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{inp}/b{i}")
    stream = streams.stream_files(spark, inp, spark.createDataFrame([], schema).schema)
    streams.run_to_folder(streams.stream_states(stream, delay="1 hour", stale_after_ms=2 * 86_400_000), out, ck, mode="update")
    emitted = streams.read_folder(spark, out)
    assert "c" in {r.case_id for r in emitted.where("stale").collect()}
    assert {r.case_id: (r.state, r.rejected) for r in streams.latest_states(emitted).collect()} == {
        "c": ("approved", 0), "d": ("approved", 0)}


EVENTS = "case_id string, seq long, to_state string, ts timestamp_ntz"


def _settled(spark, tmp_path, batches, delay="1 day"):
    """Rows that ``settled_states`` emits by batch folder, one run for each batch."""
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{inp}/b{i}")
        stream = streams.stream_files(spark, inp, spark.createDataFrame([], EVENTS).schema, None)
        streams.run_to_folder(streams.settled_states(stream, delay=delay), out, ck, state_partitions=2, rocksdb=True)
    return streams.read_folder(spark, out)


def test_events_settle_once_in_seq_order(spark, tmp_path):
    """Out of order within the delay, three cases, a late event, and rows that no watermark passes."""
    hour = dt.timedelta(hours=1)
    batches = [
        [("c", 3, "approved", T0 + 3 * hour), ("c", 1, "received", T0 + hour), ("d", 1, "approved", T0)],
        [("c", 2, "pending_approval", T0 + 2 * hour), ("d", 2, "received", T0 + 2 * hour)],
        [("e", 1, "received", T0 + 4 * DAY)],                                       # settles c and d
        [("c", 4, "published", T0 + 5 * DAY), ("d", 1, "received", T0 + 5 * DAY), ("c", 2, "received", T0 + 5 * DAY)],
        [("x", None, None, T0 + 9 * DAY)],                                          # a heartbeat
        [("c", 5, "published", T0 + 10 * DAY)],                                     # waits
    ]
    out = _settled(spark, tmp_path, batches)
    rows = sorted((r.case_id, r.seq, r.from_state, r.state, r.accepted) for r in out.where("not late").collect())
    assert rows == [
        ("c", 1, None, "received", True), ("c", 2, "received", "pending_approval", True),
        ("c", 3, "pending_approval", "approved", True), ("c", 4, "approved", "published", True),
        ("d", 1, None, None, False), ("d", 2, None, "received", True), ("e", 1, None, "received", True)]
    assert sorted((r.case_id, r.seq) for r in out.where("late").collect()) == [("c", 2), ("d", 1)]
    assert {r.case_id: (r.state, r.accepted, r.rejected) for r in streams.settled_finals(out).collect()} == {
        "c": ("published", 4, 0), "d": ("received", 1, 1), "e": ("received", 1, 0)}


def test_an_event_waits_for_smaller_ones_that_wait(spark, tmp_path):
    """Seq 2 is older than seq 1: it settles only when the watermark has passed both."""
    batches = [[("c", 1, "received", T0 + 3 * DAY), ("c", 2, "pending_approval", T0)],
               [("d", 1, "received", T0 + 3 * DAY)], [("d", 2, "approved", T0 + 8 * DAY)]]
    out = _settled(spark, tmp_path, batches)
    assert sorted((r.case_id, r.seq, r.state) for r in out.collect()) == [
        ("c", 1, "received"), ("c", 2, "pending_approval"), ("d", 1, "received")]


def test_settled_chain_equals_the_batch_chain(spark, tmp_path):
    from claimtrail.operators import chain
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    events = spark.createDataFrame([(c, i, i * 1000, "e", "c", {"k": str(i)}) for c in (1, 2) for i in range(6)],
                                   "chain long, seq long, ts_us long, event string, case_id string, details map<string,string>")
    timed = events.withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(seq as int))"))
    beat = timed.limit(1).withColumn("seq", F.lit(None).cast("long")).withColumn("ts", F.expr("timestamp_ntz '2024-02-01 00:00:00'"))
    for name, rows in (("b1", timed.where("seq in (0, 3)")), ("b2", timed.where("seq in (1, 2, 4)")), ("b3", timed.where("seq = 5")), ("b4", beat)):
        rows.coalesce(1).write.parquet(f"{inp}/{name}")
        streams.run_to_folder(streams.settled_chain(streams.stream_files(spark, inp, timed.schema, None)), out, ck, state_partitions=2, rocksdb=True)
    got = sorted((r.chain, r.seq, r.previous_hash, r.event_hash) for r in streams.read_folder(spark, out).collect())
    assert got == sorted((r.chain, r.seq, r.previous_hash, r.event_hash) for r in chain.chain_append(events).collect())


def test_sources_that_come_late_ground_earlier_citations(spark, tmp_path):
    cites, sources, out, ck = (str(tmp_path / x) for x in ("cites", "sources", "out", "ck"))
    c_schema, s_schema = "case_id string, cpos long, source_id string, quote string, ts timestamp", "case_id string, source_id string, text string, ts timestamp"
    minute = dt.timedelta(minutes=1)
    batches = [
        ([("a", 0, "s", "quote", T0), ("a", 1, "t", "other", T0), ("b", 0, "s", " ", T0), ("b", 1, "u", "x", T0)], []),
        ([], [("a", "s", "a quote here", T0 + 9 * minute), ("a", "t", "nothing", T0 + 9 * minute), ("b", "s", "text", T0 - 9 * minute),
              ("b", "u", "x", T0 + 50 * minute)]),         # too far away
        ([("z", 9, "z", "z", T0 + DAY)], [("z", "z", "z", T0 + DAY)]),
    ]
    for i, (c, s) in enumerate(batches):
        spark.createDataFrame(c, c_schema).coalesce(1).write.parquet(f"{cites}/b{i}")
        spark.createDataFrame(s, s_schema).coalesce(1).write.parquet(f"{sources}/b{i}")
        joined = streams.stream_validate_late_sources(
            streams.stream_files(spark, cites, spark.createDataFrame([], c_schema).schema, None),
            streams.stream_files(spark, sources, spark.createDataFrame([], s_schema).schema, None), "30 minutes")
        streams.run_to_folder(joined, out, ck, state_partitions=2)
    got = {(r.case_id, r.cpos): r.status for r in streams.read_folder(spark, out).where("case_id <> 'z'").collect()}
    assert got == {("a", 0): "ok", ("a", 1): "unresolved", ("b", 0): "unresolved", ("b", 1): "unknown_source"}


class _Held:
    """The state of one bucket, with its calls counted."""

    def __init__(self):
        self.calls, self.timers, self.kept = 0, set(), {}

    def state(self, name):
        outer = self

        class State:
            def get(self):
                outer.calls += 1
                return outer.kept.get(name) if name != "waiting" else iter(outer.kept.get(name, []))

            def update(self, value):
                outer.calls += 1
                outer.kept[name] = value

            put = update

            def appendValue(self, value):
                outer.calls += 1
                outer.kept.setdefault(name, []).append(value)

            def clear(self):
                outer.calls += 1
                outer.kept.pop(name, None)
        return State()

    def getListState(self, name, schema):
        return self.state(name)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return 500


def test_the_keys_of_a_bucket_share_their_state_calls():
    """A thousand cases cost as many state calls as one; each settles by itself."""
    import pandas as pd
    from claimtrail.operators.workflow import transition_matrix
    held, states = _Held(), streams._States(transition_matrix(False))
    states.init(held)
    rows = [(f"k{c}", 2 - i, ("pending_approval", "received")[i], 100 + i) for i in range(2) for c in range(1000)]
    rows += [("k7", 3, "approved", 900), ("k8", 4, "approved", 300), ("k8", 3, "approved", 900), ("k9", -1, None, 50)]
    list(states.handleInputRows((0,), iter([pd.DataFrame(rows, columns=states.columns)]), held))
    assert held.timers == {100}
    held.timers.clear()
    out = pd.concat(list(states.handleExpiredTimer((0,), held, None)))
    assert held.calls < 12 and held.timers == {900}
    assert len(out) == 2000 and set(out[out.seq == 2].state) == {"pending_approval"} and set(out[out.seq == 2].n_accepted) == {2}
    late = pd.concat(list(states.handleInputRows((0,), iter([pd.DataFrame([("k5", 2, "approved", 800)], columns=states.columns)]), held)))
    assert late.late.tolist() == [True] and held.timers == {900}


def test_a_null_case_settles_beside_others(spark, tmp_path):
    inp, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    big = 2 ** 62
    rows = [(None, big + 1, "pending_approval", T0), (None, big, "received", T0), ("", 1, "received", T0), ("x", 9, None, T0), ("x", None, None, T0 + 9 * DAY)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{inp}/b0")
    stream = streams.stream_files(spark, inp, spark.createDataFrame([], EVENTS).schema, None)
    streams.run_to_folder(streams.settled_states(stream, buckets=1), out, ck, state_partitions=2, rocksdb=True)
    got = {(r.case_id, r.seq, r.state, r.accepted) for r in streams.read_folder(spark, out).collect()}
    assert got == {(None, big, "received", True), (None, big + 1, "pending_approval", True), ("", 1, "received", True), ("x", 9, None, False)}
