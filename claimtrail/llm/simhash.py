"""SimHash near-duplicates with bit-sliced comparison.

Distinct fingerprints meet in tables keyed on all but two of five bit groups:
two fingerprints that differ in at most two bits agree on at least three
groups.  A key with more than 2,048 fingerprints is keyed again on three of
five parts of its free bits, after which at most ten or eleven bits are free,
so every bucket has a size bound, whatever the data.  Buckets are packed into
blocks and compared plane by plane: bit plane k of a block holds bit k of every
fingerprint, and carry-save counters add the 64 difference planes for all pairs
at once, saturating above the radius; a block is abandoned when every pair of
different fingerprints has saturated.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import key_id, partitions, real_id, slices, stored, texts
from .graph import components

SHINGLE = 3
RADIUS = 2
SEED = 42
BUCKET = 2048       # a bucket beyond this is keyed again; by construction none is left beyond it
BLOCK = 512         # fingerprints that are compared together, unless one bucket is larger


# -- fingerprints -----------------------------------------------------------
def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash; bit set if set in over half of the hashes."""
    words = text.encode().lower().split()       # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    if len(words) <= shingle:
        parts = [body]
    else:
        stops = ends[shingle - 1:].tolist()
        starts = [0, *(ends[:len(stops) - 1] + 1).tolist()]
        parts = [body[a:b] for a, b in zip(starts, stops)]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(p, SEED) for p in parts]), dtype=np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(raw), 1 << 16):
        counts += np.unpackbits(raw[lo:lo + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(raw)).tobytes(), "big")


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, body long, fp long)``: id, text hash and signed fingerprint of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"_id": pdf["_id"].to_numpy(), "body": pdf["body"].to_numpy(), "fp": fps})

    hashed = texts(df, id_col, text_col).withColumn("body", F.xxhash64("text"))
    return hashed.mapInPandas(run, "_id long, body long, fp long")


# -- candidate tables -------------------------------------------------------
def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _groups(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` groups of nearly equal size."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def tables(radius: int) -> list[tuple[int, list[int]]]:
    """(mask, masks of the second keying) for every table."""
    out = []
    for free in combinations(_groups(list(range(64)), radius + 3), radius):
        rest = sum(free)
        inner = _groups([b for b in range(64) if rest >> b & 1], radius + 3)
        out.append((((1 << 64) - 1) ^ rest,
                    [((1 << 64) - 1) ^ sum(x) for x in combinations(inner, radius)]))
    return out


def _keyed(fps: DataFrame, radius: int) -> DataFrame:
    """``(t, key, fp)`` of all buckets with at least two fingerprints."""
    plan = tables(radius)
    first = ", ".join(f"named_struct('t', {t}, 'key', fp & {_signed(m)}L)" for t, (m, _) in enumerate(plan))
    keys = fps.select("fp", F.expr(f"inline(array({first}))"))
    many = keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(many, ["t", "key"])
    inner = ", ".join("array(" + ", ".join(f"{_signed(m)}L" for m in ms) + ")" for _, ms in plan)
    again = shared.where(f"n > {BUCKET}").select(
        "fp", F.expr(f"inline(transform(element_at(array({inner}), t + 1), "
                     f"(m, s) -> named_struct('t', (t + 1) * 1000 + s, 'key', fp & m)))"))
    return shared.where(f"n <= {BUCKET}").select("t", "key", "fp").unionByName(again.select("t", "key", "fp"))


# -- bit-sliced comparison --------------------------------------------------
def near(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Boolean matrix of the pairs within ``radius``, for uint64 fingerprints."""
    n = len(fps)
    lanes = -(-n // 64)
    bits = np.zeros((64, lanes * 64), dtype=np.uint8)
    bits[:, :n] = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1).T
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)      # [bit, lane word]
    flips = (bits[:, :n].astype(np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF))    # [bit, row]
    width = radius.bit_length()
    count = [np.zeros((n, lanes), dtype=np.uint64) for _ in range(width)]      # carry-save counters
    over = np.zeros((n, lanes), dtype=np.uint64)
    own = np.zeros((n, lanes), dtype=np.uint64)
    own[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n, dtype=np.uint64) % np.uint64(64))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    unused = np.zeros(lanes * 64, dtype=np.uint8)
    unused[n:] = 1
    own |= np.packbits(unused, bitorder="little").view(np.uint64)[None, :]
    for k in range(64):
        carry = planes[k][None, :] ^ flips[k][:, None]
        for c in range(width):
            count[c], carry = count[c] ^ carry, count[c] & carry
        over |= carry
        if k % 8 == 7 and bool(((over | own) == full).all()):
            return np.eye(n, dtype=bool)
    for value in range(radius + 1, 1 << width):        # counts that fit but exceed the radius
        hit = ~np.zeros_like(over)
        for c in range(width):
            hit &= count[c] if value >> c & 1 else ~count[c]
        over |= hit
    inside = np.unpackbits((~over).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")[:, :n].astype(bool)
    return inside


def forest(fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """(row, root row) links that connect what ``radius`` connects."""
    linked = near(fps, radius)
    left = linked.sum(axis=1) > 1
    while left.any():
        root = int(left.argmax())
        reached = linked[root].copy()
        edge = reached
        while True:
            more = linked[edge].any(axis=0) & ~reached
            if not more.any():
                break
            reached |= more
            edge = more
        left &= ~reached
        for i in np.nonzero(reached)[0].tolist():
            if i != root:
                yield i, root


def _links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (t, key); whole buckets are packed into blocks."""
        held: list[np.ndarray] = []         # finished buckets
        size, last, t, key = 0, [], None, None

        def compare():
            fps = np.unique(np.concatenate(held))
            pairs = list(forest(fps.view(np.uint64), radius))
            if pairs:
                a, b = np.array(pairs).T
                yield pd.DataFrame({"u": fps[a], "v": fps[b]})

        for pdf in batches:
            ts, keys, fps = (pdf[c].to_numpy() for c in ("t", "key", "fp"))
            new = np.concatenate([[len(ts) > 0 and (ts[0], keys[0]) != (t, key)],
                                  (ts[1:] != ts[:-1]) | (keys[1:] != keys[:-1])])
            cuts = [0, *np.nonzero(new)[0].tolist(), len(ts)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < len(ts) and new[lo] and last:      # the bucket before is complete
                    bucket = np.concatenate(last)
                    last = []
                    if size + len(bucket) > BLOCK and held:
                        yield from compare()
                        held, size = [], 0
                    held.append(bucket)
                    size += len(bucket)
                if hi > lo:
                    last.append(fps[lo:hi])
            if len(ts):
                t, key = ts[-1], keys[-1]
        if last:
            held.append(np.concatenate(last))
        if held:
            yield from compare()

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)`` links between the distinct fingerprints of ``fps(fp)`` that
    connect exactly what a distance of at most ``radius`` connects."""
    buckets = (_keyed(fps, radius).repartition(partitions(fps.sparkSession), "t", "key")
               .sortWithinPartitions("t", "key"))
    return buckets.mapInPandas(_links(radius), "u long, v long").distinct()


# -- the operator -----------------------------------------------------------
def assign(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id, body, keep)`` for every row.

    Null and empty texts (no words) have fingerprint zero and link like any
    other; repeated rows share it; ``component_id`` is the smallest id reachable,
    nulls ignored (null if all are); ``keep`` marks one representative text of
    each component, the one of the smallest id (nulls last, then text hash); an
    empty table gives no rows; extra columns are not carried.
    """
    rows = stored(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    order = F.struct(real_id().isNull().alias("none"), F.col("_id").alias("id"), F.col("body").alias("body"))
    per = rows.groupBy("fp").agg(F.min(real_id()).alias("low"), F.min(order).alias("first"))
    found = components(links(per.select("fp"), radius))
    joined = per.join(found, per["fp"] == found["node"]).select("fp", "low", "first", "root")
    best = joined.groupBy("root").agg(F.min("low").alias("low"), F.min("first").alias("first"))
    linked = joined.select("fp", "root").join(best, "root").select("fp", "low", "first")
    alone = per.join(found, per["fp"] == found["node"], "left_anti").select("fp", "low", "first")
    by_fp = stored(linked.unionByName(alone), "components")
    return rows.join(by_fp, "fp").select(
        real_id().alias("doc_id"), "fp", F.col("low").alias("component_id"), "body",
        ((F.col("_id") == F.col("first.id")) & (F.col("body") == F.col("first.body"))).alias("keep"))


def deduplicated(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns."""
    kept = (assign(df, shingle, radius, id_col, text_col).where("keep")
            .select(key_id("doc_id").alias("id"), "body"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(F.struct("*").alias("row"), key_id(F.col(id_col).cast("long")).alias("id"), F.xxhash64(text).alias("body"))
    return keyed.join(kept, ["id", "body"], "left_semi").dropDuplicates(["id", "body"]).select("row.*")
