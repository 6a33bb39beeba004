"""Byte-level BPE as a monoid: token lists of neighbouring byte strings are
joined by re-encoding a boundary window that grows until the tokens outside it
are proved stable; decoding concatenates up the same kind of tree.

Why a join is exact.  Merging always takes the lowest rank, leftmost first.  A
list of tokens is the encoding of its bytes if and only if every two
neighbours are the encoding of *their* bytes: before the first merge that
crosses a border, the run over the whole string restricted to the two tokens
at that border is the run over these two alone, so a crossing merge would show
there.  Inside either half all neighbours are stable already, and inside the
re-encoded window as well; only the two pairs at the window's edges need the
check, and a window that gives back the old edge token needs none.

A text is cut into halves where a white-space character follows another
character: no match of the pattern spans such a place, and no match looks
across it, so the halves' lists concatenate.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import key_id, real_id, slices, texts

LEAF_BYTES = 64         # a piece up to this size is merged directly
LEAF_CHARS = 4096       # a text up to this size is one leaf of the text's tree
CACHE_BYTES = 96 << 20  # of pieces and their ids that a task remembers, about


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_LATIN_END = 0x250
_NOT_LATIN = re.compile(f"[^\\x00-{chr(_LATIN_END - 1)}]")


def latin(pattern: str) -> str:
    """The pattern with its Unicode classes written out as ranges below U+0250,
    for Python's own matcher, which is faster; only for texts below that."""
    def ranges(name: str) -> str:
        member = [regex.match(name, chr(c)) is not None for c in range(_LATIN_END)] + [False]
        edges = [c for c in range(_LATIN_END + 1) if member[c] != (c > 0 and member[c - 1])]
        return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2]))

    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.S):
        if part in (r"\p{L}", r"\p{N}", r"\s", r"\d"):
            part = ranges(part) if inside else f"[{ranges(part)}]"
        elif part == r"\S" and not inside:
            part = f"[^{ranges('\\s')}]"
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return "".join(out)


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_bytes: int = LEAF_BYTES, leaf_chars: int = LEAF_CHARS):
        self.ranks, self.leaf_bytes, self.leaf_chars = ranks, leaf_bytes, leaf_chars
        self.none = max(ranks.values(), default=0) + 1
        self.all_pieces = regex.compile(pattern).findall
        self.latin_pieces = re.compile(latin(pattern)).findall
        self.cut = regex.compile(r"(?<=\S)\s")
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cached = 0

    # -- one piece -------------------------------------------------------
    def merge(self, piece: bytes) -> list[bytes]:
        """Greedy merging: always the lowest rank, leftmost first."""
        if len(piece) > 2 * self.leaf_bytes:
            return self._merge_long(piece)
        rank, none = self.ranks.get, self.none
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i:i + 2], none) for i in range(len(piece) - 1)]     # rank of each part with the next
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def _merge_long(self, piece: bytes) -> list[bytes]:
        """The same with a heap of pairs, for windows that had to grow."""
        n, rank = len(piece), self.ranks.get
        end = list(range(1, n + 1))         # a part starts at i and ends at end[i]
        prev, alive = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue                    # one of the two parts has changed
            gone = end[i]
            end[i], alive[gone] = stop, False
            if stop < n:
                prev[stop] = i
                if (r := rank(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [piece[i:end[i]] for i in range(n) if alive[i]]

    def stable(self, x: bytes, y: bytes) -> bool:
        return self.merge(x + y) == [x, y]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(left[-i:] + right[:j]))
            left_ok = i == len(left) or window[0] == left[-i] or self.stable(left[-i - 1], window[0])
            right_ok = j == len(right) or window[-1] == right[j - 1] or self.stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[:-i] + window + right[j:]
            i, j = i * (1 if left_ok else 2), j * (1 if right_ok else 2)

    def tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= self.leaf_bytes:
            return self.merge(piece)
        mid = len(piece) // 2
        return self.join(self.tree(piece[:mid]), self.tree(piece[mid:]))

    def piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ranks.get(raw)         # a piece that is in the vocabulary is one token
        return (whole,) if whole is not None else tuple(self.ranks[t] for t in self.tree(raw))

    # -- one text --------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        if len(text) > self.leaf_chars and (m := self.cut.search(text, len(text) // 2)):
            return self.encode(text[:m.start()]) + self.encode(text[m.start():])
        ids: list[int] = []
        cache = self.cache
        for p in (self.all_pieces if _NOT_LATIN.search(text) else self.latin_pieces)(text):
            got = cache.get(p)
            if got is None:
                got = self.piece(p)
                if len(p) <= 256:
                    self.cached += 200 + 4 * len(p) + 8 * len(got)
                    if self.cached > CACHE_BYTES:
                        self.forget()
                    cache[p] = got
            ids.extend(got)
        return ids

    def forget(self) -> None:
        self.cache.clear()
        self.cached = 0

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) > self.leaf_chars:
            mid = len(ids) // 2
            return self.decode(ids[:mid]) + self.decode(ids[mid:])
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


_BUILT: dict[int, Bpe] = {}


def built(shared, pattern: str) -> Bpe:
    """One encoder for each worker process; another vocabulary replaces it."""
    ranks = shared.value
    key = hash((pattern, frozenset(ranks.items())))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Bpe(ranks, pattern)
    return _BUILT[key]


@contextmanager
def task_encoder(shared, pattern: str) -> Iterator[Bpe]:
    """An encoder for one task: what it remembers goes with the task, as workers are used again."""
    bpe = built(shared, pattern)
    try:
        yield bpe
    finally:
        bpe.forget()
        pa.default_memory_pool().release_unused()


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row.

    The rank file is read on the driver and broadcast: a vocabulary has a fixed
    size (50,000 entries, under 2 MB), whatever the corpus.  Null and empty
    texts give an empty list; repeated rows each give their own row; the id may
    be null; extra columns are not carried.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with task_encoder(shared, pattern) as bpe:
            for pdf in slices(batches):
                yield pd.DataFrame({"_id": pdf["_id"],
                                    "ids": [np.array(bpe.encode(t), dtype=np.int32) for t in pdf["text"]]})

    return (texts(df, id_col, text_col).mapInPandas(run, "_id long, ids array<int>")
            .select(real_id().alias("doc_id"), "ids"))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, bytes)``: ``encode`` and ``decode`` of its ids in one pass, so that a task
    needs one Python worker.  The cases are those of the two."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with task_encoder(shared, pattern) as bpe:
            for pdf in slices(batches):
                ids = [bpe.encode(t) for t in pdf["text"]]
                yield pd.DataFrame({"_id": pdf["_id"], "ids": [np.array(x, dtype=np.int32) for x in ids],
                                    "bytes": [bpe.decode(x) for x in ids]})

    return (texts(df, id_col, text_col).mapInPandas(run, "_id long, ids array<int>, bytes binary")
            .select(real_id().alias("doc_id"), "ids", "bytes"))


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, ids, bytes binary)``: the byte string that the ids spell; null ids: no bytes.
    Repeated and equal rows each give their own row, an empty table none; extra columns,
    whatever their names, are not carried."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = built(shared, pattern)
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo:lo + 512]
                yield pd.DataFrame({"_id": part["_id"], "ids": part["ids"],
                                    "bytes": [bpe.decode(x.tolist()) for x in part["ids"]]})

    kept = df.select(key_id(F.col(id_col).cast("long")).alias("_id"),
                     F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return (kept.mapInPandas(run, "_id long, ids array<int>, bytes binary")
            .select(real_id().alias("doc_id"), "ids", "bytes"))

