"""Exact substring joins by whole keys.

A pattern of up to ``TOP`` characters is its own key.  Of a longer one the key is the
TOP characters that hold its rarest grams, so that a beginning which many share proposes no pairs:

1. Every gram of a long pattern (``GRAM`` characters) is counted in all texts, which look at every
   ``STRIDE``-th position only, of which every occurrence covers one in any STRIDE
   consecutive gram starts.  What a gram costs is shared by the patterns of one length that
   have it in the same place.  A pattern with a gram that does not occur where it must is in no text.
2. Keys are hashed into one bitmap, and so are their heads: keys are put into classes by length, the class p
   covers the lengths from p to below 3 p, and a head is a key's first p characters.  A task looks at every
   position of its texts, whose head the bitmap must hold, and then at the lengths of the class.  Only the keys
   that the bitmap holds, as text and not as hashes, leave the task, each once for a text: what is shuffled are the
   occurrences and the few false hits of the bitmap, whatever the texts' length and the grams they share.
3. These keys are joined; beyond TOP characters ``contains`` settles the pair.

The bitmap has sixteen bits for a key, at most ``1 << MOST``; it only steers the work: a collision costs a row, and no
pair is gained or lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

TOP = 128               # longest key
CLASSES = (1, 3, 9, 27, 81)
GRAM, STRIDE = 40, 42   # of patterns beyond TOP: a gram's characters, and the texts' places that are counted
MARKS = 18              # log2 of the bits that grams are counted by, and of the smallest bitmap of keys
MOST = 28               # log2 of the largest bitmap of keys
PART = 19               # log2 of the bits that one task packs
CHARS = 1 << 17         # characters that a task hashes at a time (one text at least)

_MULTIPLIER = 0x9E3779B97F4A7C15


# -- in a task -------------------------------------------------------------
def _runs(texts: pd.Series) -> Iterator[slice]:
    """Rows of about CHARS characters together."""
    ends, lo = texts.str.len().cumsum().to_numpy(), 0
    while lo < len(ends):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(ends.searchsorted(done + CHARS, side="right")))
        yield slice(lo, hi)
        lo = hi


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and begin of each text, and the code points of all."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    return size, begin, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class _Rolled:
    """Hashes of all substrings of some texts: a sum of powers, of which a substring's is a difference."""

    def __init__(self, points: np.ndarray) -> None:
        def powers(base: int) -> np.ndarray:
            factors = np.full(len(points) + 1, base, np.uint64)
            factors[0] = 1
            return np.cumprod(factors, dtype=np.uint64)

        self.back = powers(pow(_MULTIPLIER, -1, 1 << 64))
        mixed = (points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers(_MULTIPLIER)[:-1], dtype=np.uint64)])

    def at(self, at: np.ndarray, n: np.ndarray | int, kind: int) -> np.ndarray:
        """The substrings of n characters; ``kind`` 0 for keys, 1 for heads."""
        h = (self.sums[at + n] - self.sums[at]) * self.back[at]
        h ^= (np.atleast_1d(n).astype(np.uint64) * np.uint64(2) + np.uint64(kind)) * np.uint64(_MULTIPLIER)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _hashes(texts: list[str], s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place, hash)`` of the grams at every s-th place of each text."""
    size, begin, points = _points(texts)
    n = np.maximum(0, (size - GRAM) // s + 1)
    row = np.repeat(np.arange(len(texts)), n)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * s
    return row, place, _Rolled(points).at(begin[row] + place, GRAM, 0)


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - MARKS)).astype(np.int64)


def _two_bits(h: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - log2)).astype(np.int64), (h & np.uint64((1 << log2) - 1)).astype(np.int64)


def _held(h: np.ndarray, bitmap: np.ndarray, log2: int) -> np.ndarray:
    first, second = ((bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1 for b in _two_bits(h, log2))
    return (first & second).astype(bool)


def _class(n: int) -> int:
    return max(p for p in CLASSES if p <= n)


# -- tables ------------------------------------------------------------------
def _pattern_grams(patterns: DataFrame) -> DataFrame:
    """``(_pid, _l, _a, _w, _g, _m)``: length, place of the gram, number of its window of STRIDE consecutive
    places (whole ones only), hash, bit."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows in _runs(pdf["_p"]):
                some = pdf.iloc[rows]
                row, place, h = _hashes(some["_p"].tolist(), 1)
                length = some["_p"].str.len().to_numpy()[row]
                whole = place < (length - GRAM + 1) // STRIDE * STRIDE
                yield pd.DataFrame({"_pid": some["_pid"].to_numpy()[row], "_l": length, "_a": place, "_w": place // STRIDE,
                                    "_g": h.view(np.int64), "_m": _bit(h)})[whole]

    return patterns.select("_pid", "_p").mapInPandas(run, "_pid long, _l int, _a int, _w int, _g long, _m int")


def _marks(grams: DataFrame) -> np.ndarray:
    """The bits of a table of grams: at most 2 ** MARKS rows reach the driver."""
    out = np.zeros(1 << MARKS, bool)
    out[[r["_m"] for r in grams.select("_m").distinct().collect()]] = True
    return out


def _counted(texts: DataFrame, marks: np.ndarray) -> DataFrame:
    """``(_m, _df)``: how often the texts have grams of a marked bit."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(1 << MARKS, np.int64)
        for pdf in batches:
            for rows in _runs(pdf["_t"]):
                n += np.bincount(_bit(_hashes(pdf["_t"].iloc[rows].tolist(), STRIDE)[2]), minlength=1 << MARKS)
        found = np.flatnonzero(shared.value & (n > 0))
        yield pd.DataFrame({"_m": found, "_df": n[found]})

    return texts.select("_t").mapInPandas(run, "_m int, _df long").groupBy("_m").agg(F.sum("_df").alias("_df"))


def _long_keys(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(_pid, _key)`` of patterns beyond TOP characters that may occur."""
    own = written(_pattern_grams(patterns), "pattern-grams")
    counted = _counted(texts, _marks(own))
    place = ["_g", "_a", "_l", "_m"]
    shared = own.groupBy(*place).agg(F.count(F.lit(1)).alias("_k"))
    costs = shared.join(counted, "_m", "left").select(*place, (F.coalesce("_df", F.lit(0)) / F.col("_k")).alias("_cost"))
    windows = own.join(costs, place).groupBy("_pid", "_w").agg(F.sum("_cost").alias("_cost"))
    rarest = windows.groupBy("_pid").agg(F.min(F.struct("_cost", "_w")).alias("_r")).where(F.col("_r._cost") > 0).select("_pid", "_r._w")
    begin = F.least(F.col("_w") * STRIDE, F.length("_p") - TOP)
    return patterns.join(rarest, "_pid").select("_pid", F.substring("_p", begin + 1, F.lit(TOP)).alias("_key"))


def anchors(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(_pid, _key, _long)`` for each pattern ``(_pid, _p)`` that may occur: the pattern itself, or of a longer one
    (``_long``) TOP characters of it."""
    short, long = patterns.where(F.length("_p") <= TOP), patterns.where(F.length("_p") > TOP)
    keys = short.select("_pid", F.col("_p").alias("_key"), F.lit(False).alias("_long"))
    if not long.isEmpty():
        keys = keys.unionByName(_long_keys(texts, long).withColumn("_long", F.lit(True)))
    return written(keys, "anchors")


def _bitmap(keys: DataFrame) -> tuple[list[int], Broadcast, int]:
    """The lengths of the keys, and the bitmap of the keys and their heads.  Tasks pack it; the driver joins the parts."""
    spark = keys.sparkSession
    counts = {r["n"]: r["k"] for r in keys.groupBy(F.length("_key").alias("n")).agg(F.count("*").alias("k")).collect()}
    log2 = min(MOST, max(MARKS, int(16 * sum(counts.values())).bit_length()))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size, begin, points = _points(pdf["_key"].tolist())
            heads = np.array([_class(n) for n in size.tolist()], np.int64)
            rolled = _Rolled(points)
            found = [b for n, kind in ((size, 0), (heads, 1)) for b in _two_bits(rolled.at(begin[:-1], n, kind), log2)]
            yield pd.DataFrame({"_b": np.unique(np.concatenate(found))})

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(1 << min(PART, log2), np.uint8)
        part[pdf["_b"].to_numpy() & (len(part) - 1)] = 1
        return pd.DataFrame({"_part": [int(pdf["_b"].iloc[0]) >> PART], "_bits": [np.packbits(part, bitorder="little").tobytes()]})

    parts = (keys.select("_key").mapInPandas(bits, "_b long").distinct()
             .groupBy(F.shiftright("_b", PART)).applyInPandas(packed, "_part long, _bits binary"))
    bitmap = np.zeros(1 << (log2 - 3), np.uint8)
    for r in parts.toLocalIterator():
        bytes_ = np.frombuffer(r["_bits"], np.uint8)
        bitmap[r["_part"] << (PART - 3):][:len(bytes_)] = bytes_
    return sorted(counts), spark.sparkContext.broadcast(bitmap), log2


def keys_in(keys: DataFrame) -> Callable[[Column], Column]:
    """A function from a text column to the array of the different ``_key`` values that may stand in the text: all
    that do, and few others."""
    lengths, shared, log2 = _bitmap(keys)
    classes = [(p, [n for n in lengths if _class(n) == p]) for p in CLASSES]

    def run(texts: list[str]) -> list[list[str]]:
        size, begin, points = _points(texts)
        rolled = _Rolled(points)
        row = np.repeat(np.arange(len(texts)), size)
        left = np.repeat(begin[1:], size) - np.arange(len(points))     # characters up to the text's end
        out: list[dict] = [{} for _ in texts]
        for p, sizes in classes:
            if not sizes:
                continue
            at = np.flatnonzero(left >= p)
            at = at[_held(rolled.at(at, p, 1), shared.value, log2)]
            for n in sizes:
                here = at[left[at] >= n]
                here = here[_held(rolled.at(here, n, 0), shared.value, log2)]
                own = row[here]
                for r, a in zip(own.tolist(), (here - begin[own]).tolist()):
                    out[r][texts[r][a:a + n]] = None
        return [list(found) for found in out]

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("")
        return pd.Series([found for rows in _runs(texts) for found in run(texts.iloc[rows].tolist())], dtype=object)

    return find


def proposed(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``(_tid, _key)``: the keys of ``anchors`` that texts may have, each once for a row of texts."""
    return texts.select("_tid", F.explode(keys_in(found)(F.col("_t"))).alias("_key"))


def numbered(patterns: DataFrame, pattern: str) -> DataFrame:
    """``(_pid, _p)``: a number for each different pattern that is not empty; written, so it stays."""
    p = patterns.select(F.col(pattern).alias("_p")).where(F.length("_p") > 0).distinct()
    return written(p.select("_p", F.monotonically_increasing_id().alias("_pid")), "patterns")


def containing(texts: DataFrame, text_id: str, text: str, patterns: DataFrame, pattern_id: str, pattern: str) -> DataFrame:
    """Distinct ``(pattern_id, text_id)`` where the pattern occurs in the text.
    Null and empty patterns, null and empty texts and null text ids match nothing.  Equal
    patterns under several ids match under each; a repeated id stands for all of its rows."""
    ids = patterns.select(F.col(pattern_id).alias("_id"), F.col(pattern).alias("_p")).where(F.length("_p") > 0)
    p = numbered(patterns, pattern)
    t = texts.select(F.col(text_id).alias("_tid"), F.col(text).alias("_t")).where((F.length("_t") > 0) & F.col("_tid").isNotNull())
    keys = anchors(t, p)
    pairs = proposed(t, keys).join(keys, "_key")
    if keys.where("_long").isEmpty():       # every key is a whole pattern
        pairs = pairs.select("_pid", "_tid")
    else:
        pairs = written(pairs.select("_pid", "_tid", "_long").distinct(), "pairs")
        long = pairs.where("_long").join(p, "_pid").join(t, "_tid").where(F.contains("_t", "_p")).select("_pid", "_tid")
        pairs = pairs.where(~F.col("_long")).select("_pid", "_tid").unionByName(long)
    names = ids.join(p, "_p").select("_pid", F.col("_id").alias(pattern_id))
    return pairs.withColumnRenamed("_tid", text_id).join(names, "_pid").select(pattern_id, text_id).distinct()
