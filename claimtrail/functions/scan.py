"""Exact ordered state-machine fold that splits hot keys across tasks.

A fold over a finite state machine is a composition of functions on a small
state set, and composition is associative.  So:

1. range-partition the events on (key, order) and sort inside partitions; a
   key with a third of all rows spreads over many partitions; materialize
   with a reliable checkpoint so both passes read one layout;
2. pass 1 (per partition, streaming Arrow batches): for the first and the
   last key of the partition, the composed transition vector
   ``start state → end state`` — two tiny rows per partition;
3. on the driver: walk these ≤ 2·partitions rows in order to get the state a
   key is in when it enters each partition (the only driver-side data);
4. pass 2 (per partition, streaming): replay every event from that entering
   state and emit the state before and after it.

No key is ever gathered into one task or one row, and memory per task is one
Arrow batch plus the sort's spill.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root


def next_state_matrix(allowed) -> np.ndarray:
    """``nxt[from][to]``: the state after a transition, -1 when it is
    rejected.  A boolean matrix means "allowed → the target state"."""
    m = np.array(allowed)
    if m.dtype == bool:
        n = m.shape[0]
        return np.where(m, np.broadcast_to(np.arange(n), (n, n)), -1).astype(np.int64)
    return m.astype(np.int64)


def fsm_fold(events: DataFrame, key: str, order: str, target: str,
             allowed, num_partitions: int | None = None) -> DataFrame:
    """Replay ``events`` (key, order, target state id ≥ 1) through a
    transition table (state 0 = no state yet): a boolean ``allowed[from][to]``
    or a next-state matrix (-1 = rejected; a no-op is a transition whose next
    state is its source).  A rejected transition leaves the state as it was
    and is reported as not accepted.

    Returns the events with ``state_before``, ``state_after`` and
    ``accepted``.
    """
    spark = events.sparkSession
    checkpoint_root(spark)
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    nxt = next_state_matrix(allowed)
    base = events.select(F.col(key).alias("_k"), F.col(order).cast("bigint").alias("_o"),
                         F.col(target).cast("int").alias("_t"))
    laid = (base.repartitionByRange(n_parts, "_k", "_o")
            .sortWithinPartitions("_k", "_o")
            .withColumn("_pid", F.spark_partition_id())     # stored, so later plans may coalesce or union
            .checkpoint(eager=True))
    key_type = laid.schema["_k"].dataType

    summary_schema = T.StructType([
        T.StructField("pid", T.IntegerType()),
        T.StructField("first_key", key_type), T.StructField("last_key", key_type),
        T.StructField("first_comp", T.ArrayType(T.IntegerType())),
        T.StructField("last_comp", T.ArrayType(T.IntegerType())),
    ])

    def summarize(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = None
        n_states = nxt.shape[0]
        first_key = last_key = None
        first_comp = None
        seg_key, seg = None, np.arange(n_states)
        seen = False
        for pdf in it:
            ks, ts = pdf["_k"].to_numpy(), pdf["_t"].to_numpy()
            pid = int(pdf["_pid"].iloc[0]) if len(pdf) else pid     # one task reads one checkpointed partition here
            for k, t in zip(ks, ts):
                if not seen:
                    seen, first_key, seg_key = True, k, k
                elif k != seg_key:
                    if first_comp is None:
                        first_comp = seg.copy()
                    seg_key, seg = k, np.arange(n_states)
                step = nxt[seg, t]
                seg = np.where(step >= 0, step, seg)
        if not seen:
            return
        last_key = seg_key
        if first_comp is None:
            first_comp = seg.copy()
        yield pd.DataFrame({"pid": [pid], "first_key": [first_key], "last_key": [last_key],
                            "first_comp": [first_comp.astype("int32").tolist()],
                            "last_comp": [seg.astype("int32").tolist()]})

    rows = sorted(laid.mapInPandas(summarize, summary_schema).collect(), key=lambda r: r["pid"])
    entering: dict[int, int] = {}
    carry_key, carry_state, have = None, 0, False
    for r in rows:
        enter = carry_state if (have and r["first_key"] == carry_key) else 0
        entering[r["pid"]] = int(enter)
        if r["first_key"] == r["last_key"]:
            end = r["first_comp"][enter]
        else:
            end = r["last_comp"][0]
        carry_key, carry_state, have = r["last_key"], int(end), True

    out_schema = T.StructType([
        T.StructField(key, key_type), T.StructField(order, T.LongType()),
        T.StructField(target, T.IntegerType()),
        T.StructField("state_before", T.IntegerType()),
        T.StructField("state_after", T.IntegerType()),
        T.StructField("accepted", T.BooleanType()),
    ])
    enter_map = dict(entering)

    def replay(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_pid = cur_key = None
        cur = 0
        for pdf in it:
            ks, ts, pids = pdf["_k"].to_numpy(), pdf["_t"].to_numpy(), pdf["_pid"].tolist()
            before = np.empty(len(ks), dtype=np.int32)
            after = np.empty(len(ks), dtype=np.int32)
            for i, (k, t, pid) in enumerate(zip(ks, ts, pids)):
                if pid != cur_pid:
                    cur_pid, cur_key, cur = pid, k, enter_map.get(pid, 0)
                elif k != cur_key:
                    cur_key, cur = k, 0
                before[i] = cur
                step = nxt[cur, t]
                if step >= 0:
                    cur = int(step)
                after[i] = cur
            yield pd.DataFrame({key: ks, order: pdf["_o"].to_numpy(), target: ts,
                                "state_before": before, "state_after": after,
                                "accepted": nxt[before, ts] >= 0})

    return laid.mapInPandas(replay, out_schema)
