"""Suffix-array de-duplication by bucket-pointer refinement.

Every byte that a repeated 100-byte string covers goes.  Suffixes are sampled and
bucketed by q-grams and equal stretches are settled by ``segments``; the suffixes
of different stretches in a bucket are sorted here, to the depth that decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import segments
from ._common import real_id, slices

LENGTH = 100        # bytes of a repeated string
GRAM = 32           # bytes of the sampled q-grams that bucket the suffixes
FIRST = 8           # bytes of the first buckets of the refinement

_VALUE = segments.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def buckets(bodies: list[bytes], length: int, first: int = FIRST) -> np.ndarray:
    """Bucket identifier of every ``length``-byte window of the bodies, in order:
    equal windows, and only they, have equal identifiers.

    Positions start in buckets of their first ``first`` bytes.  A round sorts them by
    (own bucket, bucket ``h`` places on), where h is the depth reached so far, and
    the new identifiers are the pointers of the next round, which so doubles the
    depth; the last round overlaps to end at ``length``.  Positions too close to a
    body's end for a depth get pointers that no window uses.
    """
    flat = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    n, depth = len(flat), min(first, length)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(depth):
        key[:n - j] |= flat[j:].astype(np.uint64) << np.uint64(8 * j)
    pointer = np.unique(key, return_inverse=True)[1]
    while 2 * depth <= length:
        later = np.concatenate([pointer[depth:], np.zeros(min(depth, n), dtype=pointer.dtype)])[:n]
        pointer = np.unique(pointer * n + later, return_inverse=True)[1]
        depth *= 2
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    count = np.maximum(0, sizes - length + 1)
    starts = np.repeat(np.cumsum(sizes) - sizes, count)
    p = starts + np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
    if depth < length:
        return np.unique(pointer[p] * n + pointer[p + length - depth], return_inverse=True)[1]
    return pointer[p]


def again(ids: np.ndarray, starts: np.ndarray, count: np.ndarray, bodies: list[bytes], length: int) -> np.ndarray:
    """Which windows come after the first of their bucket, by id, then start."""
    same, of = buckets(bodies, length), np.repeat(ids, count)
    order = np.lexsort((starts, of, same))
    s, i, p = same[order], of[order], starts[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.zeros(len(s), dtype=bool)
    out[order] = segments.later(i, p, i[first], p[first], True)
    return out


def _symbols(text: str):
    raw = text.encode()
    return _VALUE[np.frombuffer(raw, dtype=np.uint8)], raw


def _body(raw: bytes, lo: int, hi: int) -> bytes:
    return raw[lo:hi]


def spec(length: int = LENGTH, gram: int = GRAM, **sizes: int) -> segments.Spec:
    if length - gram > segments.REACH:
        raise ValueError(f"strings of {length} bytes need grams of {length - segments.REACH} bytes or more")
    return segments.Spec(length, gram, True, _symbols, _body, lambda *x: again(*x, length), **sizes)


def removed(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
            bucket: int = segments.BUCKET, **sizes: int) -> DataFrame:
    """``(doc_id, n_bytes, spans array<struct<start, end>>, kept binary)`` for every
    row: the maximal runs of bytes that a string of ``length`` bytes with an earlier
    start covers (smaller id, or the same id further ahead), and the other bytes.

    Null texts count as empty; a null id is smaller than all others; rows that
    share an id count as one document, so equal places in them don't repeat each
    other; long documents are cut in pieces whose windows overlap; an empty table
    gives no rows; extra columns are not carried.
    """
    docs, found = segments.repeats(df, spec(length, gram, **sizes), id_col, text_col, bucket)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            out = []
            for i, text, tag, *spans in zip(pdf["_id"].tolist(), pdf["text"], pdf["tag"].tolist(),
                                            pdf["tags"], pdf["los"], pdf["his"]):
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                gone = segments.covered(*spans, tag, len(raw), length)
                out.append((i, len(raw), [{"start": int(a), "end": int(b)} for a, b in zip(*segments.runs(gone))],
                            raw[~gone].tobytes()))
            yield pd.DataFrame(out, columns=["_id", "n_bytes", "spans", "kept"])

    return segments.joined(docs, found).mapInPandas(
        run, "_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary").select(
        real_id().alias("doc_id"), "n_bytes", "spans", "kept")
