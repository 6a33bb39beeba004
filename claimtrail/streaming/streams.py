"""K1-K7: the workflow as Structured Streaming.

The reference handles one event at a time; here events arrive as a stream of
files.  Windows and late-data rules are ours: event time is the ``ts``
column cast to ``timestamp`` (session zone UTC), and every stateful operator
carries a watermark so its state is bounded.

Sinks go through ``foreachBatch`` with one folder per batch id written in
overwrite mode, so a batch that is replayed after a failure rewrites the same
folder — the sink is idempotent and the stream exactly-once end to end.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.chain import GENESIS, record_canon
from ..operators.workflow import STATE_IDS, transition_matrix
from ..session import numbered_entries, scratch_path


# ---------------------------------------------------------------- replay helpers
def replay(df: DataFrame, ts: str, path: str, run: Callable[[], None], n_slices: int = 4, jitter_ms: int = 0,
           key: str | None = None, hold_ms: int | None = None) -> None:
    """Replay utility for tests and the registered stream queries: ``df`` arrives in ``n_slices`` folders, each written
    in parallel, and ``run`` continues the stream from its checkpoint after each of them, so a slice is one micro-batch.

    Rows arrive in the order of ``ts``; with ``jitter_ms`` each up to so much later, by a hash of ``key``.  With
    ``hold_ms`` a last folder holds a heartbeat: the first row without its ``key``, ``hold_ms`` after the end.
    The slices' bounds come from one approximate-quantile pass (they need only be roughly even)."""
    spark = df.sparkSession
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    arrival = micros + F.pmod(F.xxhash64(key), F.lit(jitter_ms)) * 1000 if jitter_ms else micros
    qs = df.select(arrival.alias("_t")).approxQuantile("_t", [i / n_slices for i in range(1, n_slices)], 0.01)
    bounds = [None, *map(int, qs), None]
    for i in range(n_slices):
        cond = F.lit(True)
        if bounds[i] is not None:
            cond = cond & (arrival > F.lit(bounds[i]))
        if bounds[i + 1] is not None:
            cond = cond & (arrival <= F.lit(bounds[i + 1]))
        df.where(cond).repartitionByRange(spark.sparkContext.defaultParallelism, arrival).write.parquet(f"{path}/slice={i:04d}")
        run()
    end = df.agg(F.max(ts)).first()[0] if hold_ms is not None else None
    if end is not None:
        late = F.lit(end) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hold_ms / 1000))
        beat = df.limit(1).select(*[
            late.cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) if f.name == key
            else F.col(f.name) for f in df.schema.fields])
        beat.write.parquet(f"{path}/slice={n_slices:04d}")
        run()


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = 1) -> DataFrame:
    """Files as a stream, ``files_per_batch`` at a time (None: all that are there)."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


# Lists, timers and state outside the heap; commits upload what changed.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _start(writer, spark: SparkSession, state_partitions: int | None, rocksdb: bool = False):
    """Start a query; ``state_partitions`` fixes the number of state-store
    partitions of a new checkpoint (Spark copies the session when a stream
    starts, so the caller's settings are restored right after)."""
    settings = dict(ROCKSDB) if rocksdb else {}
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run_to_folder(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
                  transform: Callable[[DataFrame, int], DataFrame] | None = None,
                  state_partitions: int | None = None, rocksdb: bool = False) -> None:
    """Run a stream over everything available (``availableNow``), writing
    each micro-batch to ``out/batch=<id>`` (overwrite: a replayed batch
    replaces itself).  ``rocksdb``: for ``settled_states`` and ``settled_chain``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        b = transform(batch, batch_id) if transform else batch
        b.write.mode("overwrite").parquet(f"{out}/batch={batch_id:08d}")

    w = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(sink).trigger(availableNow=True))
    _start(w, stream.sparkSession, state_partitions, rocksdb).awaitTermination()


def read_folder(spark: SparkSession, out: str, schema: T.StructType | str | None = None) -> DataFrame:
    if not numbered_entries(spark, out, "batch="):      # no batch ran
        return spark.createDataFrame([], schema) if schema is not None else None
    return spark.read.parquet(out).drop("batch")


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# ---------------------------------------------------------------- K1
def stream_counters(stream: DataFrame, ts: str, keys: Sequence[str], size: str,
                    slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """K1: counts per (window, keys), tumbling or sliding; a window is
    emitted once the watermark passes its end (append mode)."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (event_time(stream, ts).withWatermark(ts, delay)
            .groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
            .select(F.unix_micros("w.start").alias("window_start"), F.unix_micros("w.end").alias("window_end"),
                    *keys, "n"))


# ---------------------------------------------------------------- K2
def stream_dedupe(stream: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    """K2: one row per key while the key is inside the watermark delay."""
    return event_time(stream, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


# ---------------------------------------------------------------- K3
# Rows of a key may come in any order within the watermark's delay.  The state
# therefore keeps the rows that the watermark has not passed yet, as JSON, next to
# what the passed ones came to; every emission replays the kept rows in seq order
# on top, so the latest emission is right for what has arrived, and memory for a
# key is bounded by its rows of one delay.
_K3_OUT = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("accepted", T.LongType()), T.StructField("rejected", T.LongType()),
    T.StructField("last_seq", T.LongType()), T.StructField("stale", T.BooleanType()),
    T.StructField("late", T.LongType()), T.StructField("version", T.LongType()),
])
_K3_STATE = T.StructType([
    T.StructField("state", T.IntegerType()), T.StructField("accepted", T.LongType()),
    T.StructField("rejected", T.LongType()), T.StructField("last_seq", T.LongType()),
    T.StructField("late", T.LongType()), T.StructField("version", T.LongType()), T.StructField("kept", T.StringType()),
])
_STATE_NAMES = {v: k for k, v in STATE_IDS.items()}


def _passed(kept: list, watermark_ms: int) -> int:
    """How many of the rows (by seq; their event time last) the watermark has
    passed, as a prefix: a row waits for all smaller seq that still wait."""
    n = 0
    while n < len(kept) and kept[n][-1] <= watermark_ms:
        n += 1
    return n


def stream_states(stream: DataFrame, ts: str = "ts", delay: str = "1 day",
                  stale_after_ms: int | None = None, allow_reject: bool = False) -> DataFrame:
    """K3: the workflow state machine per case over a stream of
    (case_id, seq, to_state, ts), in seq order across micro-batches for rows
    that come within ``delay``.  A row that comes after the watermark has passed
    a larger seq cannot be ordered any more and counts as ``late``.  With
    ``stale_after_ms`` a case without events for that long (event time) is
    emitted once more with ``stale = true``; it keeps its state and can go on.
    Emits the case after every batch that touched it (update mode)."""
    allowed = transition_matrix(allow_reject)
    timeout = GroupStateTimeout.EventTimeTimeout if stale_after_ms else GroupStateTimeout.NoTimeout

    def fold(rows, cur, acc, rej, last):
        for seq, to, _ in rows:
            t = STATE_IDS.get(to, 0)
            nxt = allowed[cur][t] if t else -1
            if nxt >= 0:
                cur, acc = int(nxt), acc + 1
            else:
                rej += 1
            last = max(last, seq)
        return cur, acc, rej, last

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cur, acc, rej, last, late, version, kept = state.get if state.exists else (0, 0, 0, -1, 0, 0, "[]")
        kept = json.loads(kept)
        timed_out = state.hasTimedOut
        latest = None
        if not timed_out:
            for pdf in pdfs:
                for seq, to, ms in zip(pdf["seq"].tolist(), pdf["to_state"].tolist(), pdf["_ts_ms"].tolist()):
                    latest = ms if latest is None else max(latest, ms)
                    if seq <= last:
                        late += 1
                    else:
                        kept.append([int(seq), to if isinstance(to, str) else None, int(ms)])
            kept.sort(key=lambda r: r[0])
        n = _passed(kept, state.getCurrentWatermarkMs())
        cur, acc, rej, last = fold(kept[:n], cur, acc, rej, last)
        kept = kept[n:]
        state.update((int(cur), int(acc), int(rej), int(last), int(late), int(version + 1), json.dumps(kept)))
        if stale_after_ms and latest is not None:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + int(stale_after_ms))
        now, n_acc, n_rej, n_last = fold(kept, cur, acc, rej, last)
        yield pd.DataFrame({"case_id": [key[0]], "state": [_STATE_NAMES.get(now)], "accepted": [n_acc], "rejected": [n_rej],
                            "last_seq": [n_last], "stale": [timed_out], "late": [late], "version": [version + 1]})

    s = event_time(stream, ts).withColumn("_ts_ms", (F.unix_micros(F.col(ts)) / 1000).cast("long"))
    return (s.withWatermark(ts, delay).groupBy("case_id")
            .applyInPandasWithState(step, _K3_OUT, _K3_STATE, "update", timeout))


BUCKETS = 512           # of the keys that settle: a bucket is one key of the state
CHUNK = 10_000          # rows of a state element and of an emitted frame
_KEY = "k"              # before a key's text; the null key is the empty text


def _pack(rows: Sequence[tuple], schema: pa.Schema) -> bytes:
    columns = [pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as writer:
        writer.write_batch(pa.record_batch(columns, schema=schema))
    return out.getvalue().to_pybytes()


def _unpack(packed: bytes) -> Iterator[tuple]:
    with pa.ipc.open_stream(pa.py_buffer(bytes(packed))) as reader:
        return zip(*[c.to_pylist() for c in reader.read_all().columns])


class _Settling(StatefulProcessor):
    """Keeps the rows of a bucket of keys until the watermark has passed them, then settles each key's in seq order.

    A state call costs more than a row, so the keys are dealt into buckets: the rows that wait are a list state, of which
    an element holds up to CHUNK rows that came together, and one value state has what each key's settled rows came to, and the
    bucket's timer, which stands at the earliest event time that waits.  A row waits for all smaller seq of its key
    that still wait.  Rows without a seq (heartbeats) only move the watermark."""

    columns: list       # of an input row: the key's text; seq, a text, event time in ms
    settled: list       # (name, type) of what a key's settled rows came to; the last seq comes last
    start: tuple
    out: str            # schema of an emitted row, the key's text first

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.value = handle.getValueState("settled", "packed binary, alarm long")
        self.row = pa.schema(list(zip(self.columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))))
        self.kept = pa.schema([("key", pa.string()), *self.settled])

    def settle(self, value: tuple, key: str, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        """The value after ``rows`` (seq, text), and the rows to emit."""
        raise NotImplementedError

    def late(self, key: str, seq: int, text: str | None) -> tuple:
        raise NotImplementedError

    def _frames(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.out.split(", ")]
        for i in range(0, len(rows), CHUNK):
            yield pd.DataFrame(rows[i:i + CHUNK], columns=names)

    def handleInputRows(self, key, rows, timerValues):
        packed, alarm = self.value.get() or (None, None)
        last = {k: v[-1] for k, *v in _unpack(packed)} if packed is not None else {}
        none, before, late = self.start[-1], alarm, []
        for pdf in rows:
            new = []
            for row in zip(*[pdf[c].tolist() for c in self.columns]):
                if row[1] >= 0:
                    if row[1] <= last.get(row[0], none):
                        late.append(self.late(*row[:3]))
                    else:
                        new.append(row)
            for i in range(0, len(new), CHUNK):
                self.waiting.appendValue((_pack(new[i:i + CHUNK], self.row),))
            alarm = min([row[-1] for row in new] + ([] if alarm is None else [alarm]), default=None)
        if alarm != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(alarm)
            self.value.update((_pack([], self.kept) if packed is None else bytes(packed), alarm))
        yield from self._frames(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        keys: dict[str, list] = {}
        for (chunk,) in self.waiting.get():
            for k, *row in _unpack(chunk):
                keys.setdefault(k, []).append(row)
        packed, _ = self.value.get()
        values = {k: tuple(v) for k, *v in _unpack(packed)}
        out, rest, alarm = [], [], None
        for k, rows in keys.items():
            rows.sort(key=lambda row: row[0])
            n = _passed(rows, now)
            if n:
                values[k], emitted = self.settle(values.get(k, self.start), k, [row[:2] for row in rows[:n]])
                out += emitted
            if rows[n:]:
                at = min(row[-1] for row in rows[n:] if row[-1] > now)
                alarm = at if alarm is None else min(alarm, at)
                rest += [(k, *row) for row in rows[n:]]
        if out:
            if rest:
                self.waiting.put([(_pack(rest[i:i + CHUNK], self.row),) for i in range(0, len(rest), CHUNK)])
            else:
                self.waiting.clear()
            packed = _pack([(k, *v) for k, v in values.items()], self.kept)
        if alarm is not None:
            self.handle.registerTimer(alarm)
        self.value.update((bytes(packed), alarm))
        yield from self._frames(out)

    def close(self) -> None:
        pass


def _settling(rows: DataFrame, key: str, processor: _Settling, buckets: int) -> DataFrame:
    """The rows that ``processor`` emits; ``key`` gets its type back."""
    dealt = rows.withColumn("key_text", F.coalesce(F.concat(F.lit(_KEY), F.col(key).cast("string")), F.lit(""))) \
        .withColumn("bucket", F.pmod(F.xxhash64("key_text"), F.lit(buckets)).cast("int")).drop(key)
    out = dealt.groupBy("bucket").transformWithStateInPandas(processor, processor.out, "append", "eventTime")
    own = F.when(F.col("key_text") != "", F.substring("key_text", len(_KEY) + 1, 1 << 30)).cast(rows.schema[key].dataType)
    return out.select(own.alias(key), *[c for c in out.columns if c != "key_text"])


class _States(_Settling):
    columns = ["key_text", "seq", "to_state", "settle_ms"]
    settled = [("state", pa.int64()), ("accepted", pa.int64()), ("rejected", pa.int64()), ("last_seq", pa.int64())]
    start = (0, 0, 0, -1)
    out = "key_text string, seq long, to_state string, from_state string, state string, accepted boolean, late boolean, n_accepted long, n_rejected long"

    def __init__(self, allowed: list[list[int]]):
        self.allowed = allowed

    def settle(self, value, key, rows):
        state, accepted, rejected, last = value
        out = []
        for seq, to in rows:
            before, target = state, STATE_IDS.get(to, 0)
            after = self.allowed[state][target] if target else -1
            if after >= 0:
                state, accepted = int(after), accepted + 1
            else:
                rejected += 1
            last = seq
            out.append((key, seq, to, _STATE_NAMES.get(before), _STATE_NAMES.get(state), after >= 0, False, accepted, rejected))
        return (state, accepted, rejected, last), out

    def late(self, key, seq, text):
        return (key, seq, text, None, None, False, True, None, None)


def settled_states(stream: DataFrame, ts: str = "ts", delay: str = "1 day", allow_reject: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """K3 with one row for each event (append mode): (case_id, seq, to_state, from_state, state, accepted, late,
    n_accepted, n_rejected), as G4 gives them, once the watermark has passed the event and all of its case before it.  An event
    that comes after a larger seq of its case has settled is emitted with ``late`` and changes nothing.
    An event without a seq only moves the watermark.  The state of a case is its settled state and
    the events of one delay; ``buckets`` stays as a checkpoint began, and some thousands of cases in one are well."""
    s = event_time(stream, ts).withWatermark(ts, delay).withColumn("settle_ms", (F.unix_micros(F.col(ts)) / 1000).cast("long"))
    s = s.withColumn("seq", F.coalesce(F.col("seq").cast("long"), F.lit(-1)))
    return _settling(s.select("case_id", "seq", "to_state", "settle_ms", ts), "case_id", _States(transition_matrix(allow_reject)), buckets)


def settled_finals(settled: DataFrame) -> DataFrame:
    """Final state per case of the rows that ``settled_states`` emitted."""
    return settled.where(~F.col("late")).groupBy("case_id").agg(
        F.max_by(F.struct("state", "n_accepted", "n_rejected"), "seq").alias("s")
    ).select("case_id", "s.state", F.col("s.n_accepted").alias("accepted"), F.col("s.n_rejected").alias("rejected"))


def latest_states(emitted: DataFrame) -> DataFrame:
    """Final state per case from the rows K3 emitted: those of its last version."""
    return emitted.groupBy("case_id").agg(
        F.max_by(F.struct("state", "accepted", "rejected"), "version").alias("s")
    ).select("case_id", "s.state", "s.accepted", "s.rejected")


# ---------------------------------------------------------------- K4
def stream_publish(requests: DataFrame, state: DataFrame, exported_path: str, checkpoint: str,
                   state_partitions: int | None = None) -> None:
    """K4: exactly-once publication.  Each micro-batch keeps requests for
    approved cases, drops keys already exported (anti join against the
    export table) and appends the new keys; the batch folder is keyed by the
    batch id, so a replayed batch rewrites itself and adds nothing twice.
    The anti join reads only the key column of the export table (column
    pruning); its cost grows with the number of exported keys, not with the
    stream's volume."""
    from ..functions.hashing import idempotency_key
    st = state.where(F.col("state") == "approved").select(
        "case_id", idempotency_key("case_fingerprint", "assessment_fp").alias("idempotency_key"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = batch.join(st, "case_id").groupBy("case_id", "idempotency_key").agg(
            F.min("seq").alias("first_seq"))
        # only a missing table counts as "nothing exported"; one that cannot be read stops the stream
        before = [b for b in numbered_entries(spark, exported_path, "batch=") if b != batch_id]
        if before:
            folders = [f"{exported_path}/batch={b:08d}" for b in before]
            done = spark.read.schema("idempotency_key string").parquet(*folders)
            keys = keys.join(done, "idempotency_key", "left_anti")
        keys.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{exported_path}/batch={batch_id:08d}")

    w = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True)
    _start(w, requests.sparkSession, state_partitions).awaitTermination()


# ---------------------------------------------------------------- K5
def stream_validate(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """K5: grounding of streamed citations against a source table, as a stateless stream-static left join: (case_id,
    cpos, source_id, status, reason), one row for each citation; a repeated source id grounds it if any of its texts does, as in E5."""
    from ..operators.validate import ground_citations
    return ground_citations(citations, sources)


def validate_in_batches(citations: DataFrame, sources: DataFrame, out: str, checkpoint: str,
                        state_partitions: int | None = None) -> None:
    """K5 as a sink: each micro-batch of citations is grounded as a static frame, so the optimizer
    plans every batch by its own size."""
    from ..operators.validate import ground_citations
    run_to_folder(citations, out, checkpoint,
                  transform=lambda batch, _id: ground_citations(batch, sources),
                  state_partitions=state_partitions)


def stream_validate_late_sources(citations: DataFrame, sources: DataFrame, within: str, delay: str = "1 hour") -> DataFrame:
    """K5 when the sources arrive as a stream too: a left outer stream-stream join.  A citation (case_id, cpos, source_id,
    quote, ts) meets the source (case_id, source_id, text, ts) of its id that comes at most ``within`` before or after it
    in event time; it is emitted with the source, or as ``unknown_source`` once the watermarks say that none can come.  A source
    is sent once; both sides' state is bounded by ``within`` and ``delay``."""
    from ..functions.text import is_blank
    c = event_time(citations).withWatermark("ts", delay).alias("c")
    s = event_time(sources).withWatermark("ts", delay).select(
        F.col("case_id").alias("_case"), F.col("source_id").alias("_source"), "text", F.col("ts").alias("_ts"))
    near = F.expr(f"_ts >= ts - interval {within} and _ts <= ts + interval {within}")
    j = c.join(s, (F.col("case_id") == F.col("_case")) & (F.col("source_id") == F.col("_source")) & near, "leftOuter")
    status = (F.when(F.col("_case").isNull(), F.lit("unknown_source"))
              .when(is_blank("quote") | ~F.contains("text", F.col("quote")), F.lit("unresolved")).otherwise(F.lit("ok")))
    return j.select("case_id", "cpos", "source_id", status.alias("status"))


# ---------------------------------------------------------------- K6
def case_sessions(stream: DataFrame, ts: str, key: str, gap: str, delay: str) -> DataFrame:
    """K6: activity sessions per case (events closer than ``gap``); a session
    is emitted once the watermark passes its end."""
    return (event_time(stream, ts).withWatermark(ts, delay)
            .groupBy(F.session_window(ts, gap).alias("s"), key)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.unix_micros("s.start").alias("session_start"),
                    F.unix_micros("s.end").alias("session_end"), "n"))


# ---------------------------------------------------------------- K7
_K7_STATE = T.StructType([T.StructField("tail_hash", T.StringType()), T.StructField("last_seq", T.LongType()),
                          T.StructField("version", T.LongType()), T.StructField("kept", T.StringType())])
_K7_OUT = T.StructType([
    T.StructField("chain", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("previous_hash", T.StringType()),
    T.StructField("event_hash", T.StringType()), T.StructField("settled", T.BooleanType()), T.StructField("version", T.LongType())])


def stream_chain(stream: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """K7: hash chain per chain key over a stream of audit rows (chain, seq,
    ts_us, event, case_id, details), in seq order across micro-batches for rows
    that come within ``delay`` (see K3).  The state is the settled tail and the
    rows after it; every batch emits the newly settled rows and, provisionally,
    the hashes of the kept ones (update mode; ``latest_chain`` picks the last).
    A row whose place in the chain is settled already is emitted with a null hash."""
    s = event_time(stream, ts).withColumn("_canon", record_canon()) \
        .withColumn("_ts_ms", (F.unix_micros(F.col(ts)) / 1000).cast("long"))

    def step(key, pdfs, state: GroupState):
        tail, last, version, kept = state.get if state.exists else (GENESIS, -1, 0, "[]")
        kept, out = json.loads(kept), []
        for pdf in pdfs:
            for seq, cn, ms in zip(pdf["seq"].tolist(), pdf["_canon"].tolist(), pdf["_ts_ms"].tolist()):
                if seq <= last:
                    out.append((seq, None, None, True))
                else:
                    kept.append([int(seq), cn, int(ms)])
        kept.sort(key=lambda r: r[0])
        n, prev = _passed(kept, state.getCurrentWatermarkMs()), tail
        for i, (seq, cn, _) in enumerate(kept):
            h = hashlib.sha256((cn + f"{len(prev)}:{prev}").encode("utf-8")).hexdigest()
            out.append((seq, prev, h, i < n))
            prev = h
            if i < n:
                tail, last = h, seq
        state.update((tail, int(last), int(version + 1), json.dumps(kept[n:])))
        yield pd.DataFrame([(key[0], *row, version + 1) for row in out], columns=[f.name for f in _K7_OUT.fields])

    return (s.withWatermark(ts, delay).groupBy("chain")
            .applyInPandasWithState(step, _K7_OUT, _K7_STATE, "update", GroupStateTimeout.NoTimeout))


class _Chains(_Settling):
    columns = ["key_text", "seq", "canon_text", "settle_ms"]
    settled, start = [("tail_hash", pa.string()), ("last_seq", pa.int64())], (GENESIS, -1)
    out = "key_text string, seq long, previous_hash string, event_hash string"

    def settle(self, value, key, rows):
        tail, last = value
        out = []
        for seq, canon in rows:
            before, tail, last = tail, hashlib.sha256((canon + f"{len(tail)}:{tail}").encode("utf-8")).hexdigest(), seq
            out.append((key, seq, before, tail))
        return (tail, last), out

    def late(self, key, seq, text):
        return (key, seq, None, None)


def settled_chain(stream: DataFrame, ts: str = "ts", delay: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """K7 with one row for each audit row (append mode): (chain, seq, previous_hash, event_hash), once the watermark has
    passed it and all of its chain before it.  One that comes after a larger seq of its chain has settled has null hashes;
    one without a seq only moves the watermark.  The state of a chain is its tail and the rows of one delay (``buckets``: see K3)."""
    s = event_time(stream, ts).withWatermark(ts, delay).withColumn("canon_text", record_canon()) \
        .withColumn("settle_ms", (F.unix_micros(F.col(ts)) / 1000).cast("long"))
    s = s.withColumn("seq", F.coalesce(F.col("seq").cast("long"), F.lit(-1))).select("chain", "seq", "canon_text", "settle_ms", ts)
    return _settling(s, "chain", _Chains(), buckets)


def latest_chain(emitted: DataFrame) -> DataFrame:
    """Each chained row's hashes from the last version that K7 emitted for it."""
    return emitted.groupBy("chain", "seq").agg(
        F.max_by(F.struct("previous_hash", "event_hash"), F.struct(F.col("event_hash").isNotNull(), "version")).alias("h")
    ).select("chain", "seq", "h.previous_hash", "h.event_hash")


def new_run_paths(spark: SparkSession, name: str) -> tuple[str, str, str]:
    """(input, output, checkpoint) folders for one streaming run."""
    base = scratch_path(spark, name)
    return f"{base}/in", f"{base}/out", f"{base}/ckpt"
