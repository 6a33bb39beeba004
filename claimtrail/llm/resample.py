"""Importance resampling towards a target distribution of hashed word features.

Words are found with an Aho-Corasick automaton.  Every task takes its texts in
slices of bounded size; the distinct words of a slice, each between two
delimiters (`` word ``), are the automaton's dictionary, and each carries the
payload (CRC-32 of its UTF-8 bytes, byte length).  A scan of the delimited text
emits the payloads in order; since keys begin and end with the delimiter and
hold none inside, exactly the whole words match.  The CRC of a run of
neighbouring words is composed from their payloads alone (CRC-32 is a monoid
under concatenation: appending n bytes is a linear map over GF(2)), so no run
is ever spelt out.  The dictionary never outgrows its slice, whatever the
corpus, and nothing of it is broadcast.

Bucket counts are a partial aggregate with one row for each bucket; the gains
(one integer for each bucket, a parameter) are the only data the driver holds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rank import global_rank
from ._common import key_id, real_id, slices, stored, texts

#: Bytes of a text: A-Z in lower case, other letters and digits and all of the
#: non-ASCII bytes as they are, everything else a delimiter.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


# -- CRC-32 as a monoid ---------------------------------------------------
@cache
def _appends(bit: int) -> np.ndarray:
    """What appending ``2 ** bit`` bytes does to a CRC, as four tables of 256 entries."""
    if bit == 0:
        columns = [((1 << i) >> 8) ^ zlib.crc32(bytes([(1 << i) & 255])) ^ zlib.crc32(b"\0") for i in range(32)]
    else:
        half = _appends(bit - 1)
        columns = [int(_through(half, _through(half, np.array([1 << i], np.uint32)))[0]) for i in range(32)]
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for i in range(8):
            has = (np.arange(256) >> i & 1).astype(bool)
            table[byte, has] ^= np.uint32(columns[8 * byte + i])
    return table


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24]


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of the concatenations, from both sides' CRCs and the right side's byte lengths."""
    out = left.copy()
    for bit in range(int(length.max()).bit_length() if len(length) else 0):
        on = (length >> bit & 1).astype(bool)
        out[on] = _through(_appends(bit), out[on])
    return out ^ right


# -- one slice -------------------------------------------------------------
def dictionary(words: set[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for w in words:
        raw = w.encode("latin-1")
        automaton.add_word(f" {w} ", (zlib.crc32(raw), len(raw)))
    automaton.make_automaton()
    return automaton


def payloads(part: list[str]) -> Iterator[np.ndarray]:
    """For each text its words' payloads in order, as an array of two columns."""
    folded = [t.encode("utf-8", "surrogatepass").translate(_FOLD).split() for t in part]
    spelt = [" ".join(["", *(w.decode("latin-1") for w in words), ""]) for words in folded]     # a character for each byte
    known = {w for t in spelt for w in t[1:-1].split(" ")} - {""}
    automaton = dictionary(known) if known else None
    for words, t in zip(folded, spelt):
        yield np.array([p for _, p in automaton.iter(t)], np.int64).reshape(-1, 2) if words else np.zeros((0, 2), np.int64)


def buckets_of(found: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``order`` words, by composing the payloads of neighbours."""
    crc, length = found[:, 0].astype(np.uint32), found[:, 1]
    gap = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    spaced = joined_crc(gap, crc, length)           # " word"
    run, out = crc, [crc]
    for k in range(1, min(order, len(crc))):
        run = joined_crc(run[:-1], spaced[k:], length[k:] + 1)
        out.append(run)
    return (np.concatenate(out) % np.uint32(buckets)).astype(np.int32)


# -- the operator ----------------------------------------------------------
def features(df: DataFrame, order: int = 1, buckets: int = 10_000, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words long, buckets array<int>)`` for every row: one bucket for each
    run of 1 to ``order`` words, repeats included.  Null, empty and word-less texts have
    no words and an empty array; repeated rows each give their own row; the id may be
    null; extra columns are not carried."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            found = list(payloads(pdf["text"].tolist()))
            yield pd.DataFrame({"_id": pdf["_id"].to_numpy(), "n_words": [len(x) for x in found],
                                "buckets": [buckets_of(x, order, buckets) for x in found]})

    return (texts(df, id_col, text_col).mapInPandas(run, "_id long, n_words long, buckets array<int>")
            .select(real_id().alias("doc_id"), "n_words", "buckets"))


def counts(found: DataFrame) -> DataFrame:
    """``(bucket, n)`` over all rows of ``features``; buckets that do not occur have no row."""
    return found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """Of each bucket ``floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))``
    in doubles, where s of the S source features and t of the T target features are in it.
    The driver receives at most ``buckets`` rows of each side.  Empty tables count as zeros."""
    s, t = ({r["bucket"]: r["n"] for r in counts(x).collect()} for x in (source, target))
    total_s, total_t = sum(s.values()), sum(t.values())
    return [math.floor(1000 * math.log(float((t.get(b, 0) + 1) * (total_s + buckets)) / ((s.get(b, 0) + 1) * (total_t + buckets))))
            for b in range(buckets)]


def weighted(found: DataFrame, gain: list[int]) -> DataFrame:
    """``features`` with ``n_features`` and ``weight``: the floored mean gain (floors go down), 0 without features."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = shared.value
        for pdf in batches:
            n = np.array([len(x) for x in pdf["buckets"]], np.int64)
            flat = np.concatenate([np.zeros(0, np.int32), *pdf["buckets"]])
            sums = np.diff(np.concatenate([[0], np.cumsum(gain[flat])])[np.concatenate([[0], np.cumsum(n)])])
            yield pd.DataFrame({"_id": pdf["_id"], "n_words": pdf["n_words"], "n_features": n, "weight": sums // np.maximum(n, 1)})

    narrow = found.select(key_id("doc_id").alias("_id"), "n_words", "buckets")
    return (narrow.mapInPandas(run, "_id long, n_words long, n_features long, weight long")
            .select(real_id().alias("doc_id"), "n_words", "n_features", "weight"))


def noise(id_col: str | Column, seed: int) -> Column:
    """Gumbel noise in thousandths, a function of seed and id alone (a null id as an empty one)."""
    spelt = F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(spelt, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(df: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, order: int = 1,
             buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
             target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)``, all long, one row for each row of ``df``.

    score is weight plus Gumbel noise, so the highest scores are a draw without replacement
    with odds exp(weight / 1000).  Of the N rows with ``min_words`` words or more,
    floor(percent * N / 100) are drawn, ranked 1, 2, 3 ... by score, ties to the smaller id
    (null before all); a row that is not drawn has a null rank.  Rows with equal id and score are ranked
    by weight, then by number of features; beyond that they are alike.  An empty ``df`` gives
    no rows; an empty target counts as zeros.  Extra columns are not carried.
    """
    found = stored(features(df, order, buckets, id_col, text_col), "features")
    gain = gains(found, features(target, order, buckets, target_id, target_text), buckets)
    rows = weighted(found, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    fit = F.col("n_words") >= min_words
    ranked = global_rank(rows, [fit.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "weight", "n_features",
                                F.monotonically_increasing_id()])
    drawn = percent * found.where(fit).count() // 100
    return ranked.df.select("doc_id", "n_features", "weight", "score",
                            F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
