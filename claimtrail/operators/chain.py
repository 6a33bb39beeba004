"""SHA-256 hash-chained audit trails.

An audit row is ``(chain, seq, ts_us, event, case_id, details
map<string,string>, previous_hash, event_hash)``; ``event_hash`` =
SHA-256 of the canonical form (functions.hashing) of the fields in name order
followed by the canonical previous hash.  The genesis previous hash is 64
zeros.

Appending is serial within a chain by definition (each hash needs the one
before); chains are independent, so the work is partitioned by chain and
streamed in seq order (memory stays one Arrow batch).  Verification is fully
parallel: each row needs only itself and its predecessor, found by an
equi-join on a global rank, so even a chain holding a third of all rows is
checked by many tasks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import canon
from ..functions.rank import global_rank

GENESIS = "0" * 64


def details_canon(details) -> Column:
    d = F.col(details) if isinstance(details, str) else details
    entries = F.array_sort(F.map_entries(F.coalesce(d, F.create_map().cast("map<string,string>"))))
    return F.concat(F.size(entries).cast("string"), F.lit("#"),
                    F.array_join(F.transform(entries, lambda e: F.concat(canon(e["key"]), canon(e["value"]))), ""))


def record_canon(df_cols=("case_id", "details", "event", "seq", "ts_us")) -> Column:
    """Canonical text of an audit record without its hashes (fields in name
    order; details as sorted entries)."""
    parts = []
    for c in sorted(df_cols):
        parts.append(canon(details_canon(c)) if c == "details" else canon(c))
    return F.concat(*parts)


def chain_append(events: DataFrame, chain: str = "chain", seq: str = "seq",
                 tails: DataFrame | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add ``previous_hash`` and ``event_hash`` to new events.

    ``tails(chain, tail_hash)`` (B5) continues existing chains; otherwise each
    chain starts at the genesis hash.  The canonical text is built on the JVM;
    Python only runs the SHA-256 fold, streaming each partition in
    (chain, seq) order.
    """
    spark = events.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ev = events.withColumn("_canon", record_canon())
    if tails is not None:
        ev = ev.join(tails.select(F.col(chain), F.col("tail_hash").alias("_start")), chain, "left")
    else:
        ev = ev.withColumn("_start", F.lit(None).cast("string"))
    ordered = ev.repartition(n_parts, chain).sortWithinPartitions(chain, seq)
    out_schema = T.StructType(
        [f for f in ordered.schema.fields if f.name not in ("_canon", "_start")]
        + [T.StructField("previous_hash", T.StringType()), T.StructField("event_hash", T.StringType())])
    names = [f.name for f in out_schema.fields[:-2]]

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_chain, prev, started = None, GENESIS, False
        for pdf in it:
            prevs, hashes = [], []
            for ch, cn, st in zip(pdf[chain].tolist(), pdf["_canon"].tolist(), pdf["_start"].tolist()):
                if not started or ch != cur_chain:
                    cur_chain, prev, started = ch, (st if isinstance(st, str) else GENESIS), True
                h = hashlib.sha256((cn + f"{len(prev)}:{prev}").encode("utf-8")).hexdigest()
                prevs.append(prev)
                hashes.append(h)
                prev = h
            out = pdf[names].copy()
            out["previous_hash"] = prevs
            out["event_hash"] = hashes
            yield out

    return ordered.mapInPandas(fold, out_schema)


def _links(narrow: DataFrame, chain: str, num_partitions: int | None = None) -> DataFrame:
    """Per chain (valid, bad, n) of ``(_chain, _seq, previous_hash, event_hash, _self_ok)``: ``bad`` is the first bad seq."""
    laid = global_rank(narrow, ["_chain", "_seq"], "_rk", num_partitions, keep_partition="_range").df
    ends = laid.groupBy("_range").agg(F.max_by(F.struct("_chain", "event_hash"), "_rk").alias("_end")).collect()    # one row for each range
    halo: dict[int, tuple] = {}
    before = (None, None)
    for r in sorted(ends, key=lambda r: r["_range"]):
        halo[r["_range"]] = before
        before = tuple(r["_end"])

    def check(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = last = None
        for pdf in it:
            # a task may hold several ranges, one after the other, if the plan above coalesces
            for number, part in pdf.groupby("_range", sort=False):
                last = last if number == current else halo[number]
                current = number
                key, hashes = part["_chain"], part["event_hash"]
                same = (key == key.shift(1)).to_numpy()
                same[0] = key.iloc[0] is not None and key.iloc[0] == last[0]
                expected = hashes.shift(1)
                expected.iloc[0] = last[1]
                expected = expected.where(same, GENESIS)
                bad = ~(part["_self_ok"].to_numpy() & (part["previous_hash"] == expected).to_numpy())
                last = (key.iloc[-1], hashes.iloc[-1])
                rows = pd.DataFrame({chain: key, "_bad": part["_seq"].where(bad).astype("Int64"), "_n": 1})
                yield rows.groupby(chain, as_index=False, dropna=False).agg({"_bad": "min", "_n": "sum"})

    out = T.StructType([T.StructField(chain, narrow.schema["_chain"].dataType), T.StructField("_bad", T.LongType()), T.StructField("_n", T.LongType())])
    found = laid.select("_chain", "_seq", "previous_hash", "event_hash", "_self_ok", "_range").mapInPandas(check, out)
    return found.groupBy(chain).agg(F.max("_bad").isNull().alias("valid"), F.min("_bad").alias("bad"), F.sum("_n").alias("n"))


def chain_verify(audit: DataFrame, chain: str = "chain", seq: str = "seq",
                 num_partitions: int | None = None) -> DataFrame:
    """Per chain (valid, first_bad_seq, n).

    A row is good when its recomputed hash equals ``event_hash`` and its
    ``previous_hash`` equals the predecessor's hash (genesis for the first
    row); a row with a missing field is bad, and so is every later row of a null chain
    that is not a first one.  Rows are laid out in ranges over (chain, seq); each range
    gets the last row of the one before it, so links are checked in place, and only one
    row for each chain and batch is shuffled afterwards.  A chain without rows has
    no output row and counts as valid.
    """
    a = audit.withColumn(
        "_self_ok",
        F.coalesce(F.sha2(F.concat(record_canon(), canon("previous_hash")), 256) == F.col("event_hash"),
                   F.lit(False)))
    # only what the link check needs goes through the checkpoint
    narrow = a.select(F.col(chain).alias("_chain"), F.col(seq).cast("bigint").alias("_seq"), "previous_hash", "event_hash", "_self_ok")
    return _links(narrow, chain, num_partitions).withColumnRenamed("bad", "first_bad_seq")


def chain_tail(audit: DataFrame, chain: str = "chain", seq: str = "seq") -> DataFrame:
    """Last hash and seq per chain, to resume appending."""
    return audit.groupBy(chain).agg(F.max(seq).alias("last_seq"),
                                    F.max_by("event_hash", seq).alias("tail_hash"))


# ---------------------------------------------------------------- B6
_FOREIGN = T.StructType([
    T.StructField("parsed", T.BooleanType()),
    T.StructField("recomputed", T.StringType()),
    T.StructField("event_hash", T.StringType()),
    T.StructField("previous_hash", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("case_id", T.StringType()),
])


@F.pandas_udf(_FOREIGN)
def _foreign_line(lines: pd.Series) -> pd.DataFrame:
    out = {k: [] for k in ("parsed", "recomputed", "event_hash", "previous_hash", "event", "case_id")}
    for line in lines:
        try:
            rec = json.loads(line)
            h = rec.pop("event_hash")
            prev = rec["previous_hash"]
            canonical = json.dumps(rec, sort_keys=True, separators=(",", ":"))
            vals = (True, hashlib.sha256(canonical.encode()).hexdigest(), str(h), str(prev),
                    str(rec.get("event")), str(rec.get("case_id")))
        except (ValueError, KeyError, TypeError, AttributeError):
            vals = (False, None, None, None, None, None)
        for k, v in zip(out, vals):
            out[k].append(v)
    return pd.DataFrame(out)


def canonical_json(col) -> Column:
    """Sorted, compact, ASCII-escaped JSON of a JSON text (Python's
    ``json.dumps(sort_keys=True, separators=(",", ":"))``), for verifying
    audit files written in that format; null when the text is not JSON."""
    @F.pandas_udf(T.StringType())
    def _canon(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"))
            except (TypeError, ValueError):
                return None
        return s.map(one)
    return _canon(F.col(col) if isinstance(col, str) else col)


def foreign_chain_verify(lines: DataFrame, file_col: str = "file", line_col: str = "line_no",
                         text_col: str = "line") -> DataFrame:
    """B4 for JSONL audit files in the single-chain-per-file JSON format:
    ``lines(file, line_no, line)`` (from A4).  Per file (valid,
    first_bad_line, n); a malformed line is invalid, and so is the one after it.  Links are checked as in ``chain_verify``."""
    parsed = lines.select(F.col(file_col).alias("_chain"), F.col(line_col).cast("bigint").alias("_seq"), _foreign_line(F.col(text_col)).alias("p"))
    ok_self = F.coalesce(F.col("p.parsed") & (F.col("p.recomputed") == F.col("p.event_hash")), F.lit(False))
    narrow = parsed.select("_chain", "_seq", "p.previous_hash", "p.event_hash", ok_self.alias("_self_ok"))
    return _links(narrow, file_col).withColumnRenamed("bad", "first_bad_line")
