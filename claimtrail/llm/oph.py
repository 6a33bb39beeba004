"""One-permutation MinHash fingerprints.

Every word shingle is hashed once; the high bits of the hash choose one of the
bins and a bin keeps its smallest hash.  An empty bin borrows from the first
full bin in a random order of its own, the same for all texts (optimal
densification: its choice is uniform and independent of other bins').  A bin stores only the low bits of its value re-hashed with the
bin's number, packed; the likeness of two fingerprints is the share of equal bins
with the chance of equal low bits, 2^-bits, taken out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import partitions, real_id, slices, texts

SHINGLE, BINS, BITS = 5, 512, 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of a public hash)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Oph:
    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8")
        self.bins, self.bits, self.shingle = bins, bits, shingle
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self.salt = _mix(np.arange(1, bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.order = _mix(self.salt[:, None] ^ _mix(np.arange(bins, dtype=np.uint64) + np.uint64(1 << 32))[None, :])
        self.order = self.order.argsort(axis=1).argsort(axis=1).astype(np.uint16)      # [bin, other]: its place
        self.coef = _mix(np.arange(101, 101 + shingle, dtype=np.uint64)) | np.uint64(1)
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of all word shingles (fewer words: of the whole sequence; none: empty)."""
        words = text.encode().split()           # of bytes: ASCII white space only
        if not words:
            return np.empty(0, dtype=np.uint64)
        known, digest, out = self.known, xxhash.xxh3_64_intdigest, []
        for w in words:
            h = known.get(w)
            if h is None:
                if len(known) >= 200_000:
                    known.clear()
                h = digest(w)
                if len(w) <= 64:
                    known[w] = h
            out.append(h)
        w = np.array(out, dtype=np.uint64)
        k = min(self.shingle, len(w))
        n = len(w) - k + 1
        total = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            total += _mix(w[j:j + n] ^ self.coef[j]) * self.coef[j]
        return _mix(total)

    def bins_of(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(self.bins, _EMPTY, dtype=np.uint64)
        if len(hashes):
            where = (hashes >> self.shift).astype(np.int64)
            np.minimum.at(low, where, hashes)
        return low

    def densified(self, low: np.ndarray) -> np.ndarray:
        """Every empty bin borrows from the full bin that comes first in its own order."""
        empty, full = np.nonzero(low == _EMPTY)[0], np.nonzero(low != _EMPTY)[0]
        if not len(empty) or not len(full):
            return low
        out = low.copy()
        out[empty] = low[full[self.order[empty[:, None], full].argmin(axis=1)]]
        return out

    def pack(self, low: np.ndarray) -> bytes:
        """Low bits of every bin; a text without words has its own constant."""
        full = self.densified(low)
        small = (_mix(full ^ self.salt) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        per = 8 // self.bits
        small = small.reshape(-1, per)
        return sum(small[:, j].astype(np.uint8) << np.uint8(j * self.bits) for j in range(per)).astype(np.uint8).tobytes()

    def fingerprint(self, text: str) -> bytes:
        return self.pack(self.bins_of(self.shingles(text)))

    def likeness(self, a: bytes, b: bytes) -> float:
        x = np.frombuffer(a, dtype=np.uint8) ^ np.frombuffer(b, dtype=np.uint8)
        mask = np.uint8((1 << self.bits) - 1)
        same = sum(int(np.count_nonzero((x >> np.uint8(j * self.bits)) & mask == 0)) for j in range(8 // self.bits))
        chance = 2.0 ** -self.bits
        return min(1.0, max(0.0, (same / self.bins - chance) / (1 - chance)))


_BUILT: dict[tuple, Oph] = {}


def built(bins: int, bits: int, shingle: int) -> Oph:
    return _BUILT.setdefault((bins, bits, shingle), Oph(bins, bits, shingle))


def fingerprints(df: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint binary)`` for every row.  Null and empty texts have
    the fingerprint of no words; fewer than ``shingle`` words count as one
    shingle; repeated rows repeat; extra columns are not carried."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        oph = built(bins, bits, shingle)
        for pdf in slices(batches):
            yield pd.DataFrame({"_id": pdf["_id"], "fingerprint": [oph.fingerprint(t) for t in pdf["text"]]})

    return texts(df, id_col, text_col).mapInPandas(run, "_id long, fingerprint binary").select(
        real_id().alias("doc_id"), "fingerprint")


# -- next documents and edited texts ----------------------------------------
def in_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, ahead, _id, text)``: documents dealt into ranges of ids, each range
    sorted and followed by the first document of the next range (``ahead``; the
    last range by the first of all), so that a task sees every successor.

    The driver sees the ids' quantiles and the smallest id of every range, four
    ranges for each shuffle partition.  Rows that share an id stay together.
    """
    spark = df.sparkSession
    rows, want = texts(df, id_col, text_col), 4 * partitions(df.sparkSession)
    bounds = np.array(sorted({int(b) for b in rows.approxQuantile("_id", [k / want for k in range(1, want)], 0.1 / want)}),
                      dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="left").astype(np.int32))

    heads = {r["part"]: r["head"] for r in rows.select("_id", part_of("_id").alias("part"))
             .groupBy("part").agg(F.min("_id").alias("head")).collect()}
    parts = sorted(heads)
    before = {p: parts[i - 1] for i, p in enumerate(parts)}     # of the first: the last

    @F.pandas_udf("array<int>")
    def dealt(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, ids.to_numpy(), side="left").tolist()
        return pd.Series([[p, before[p]] if i == heads[p] else [p] for p, i in zip(at, ids.tolist())])

    return (rows.select("_id", "text", F.posexplode(dealt("_id")).alias("ahead", "part"))
            .repartitionByRange(partitions(spark), "part")
            .sortWithinPartitions("part", "ahead", "_id", "text"))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def compare_edited(df: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)``: every document against its edited text and the
    next document by ascending id.

    Null texts count as empty; null ids come first; rows that share an id are
    ordered by text; after the last comes the first, so a single row is its own
    successor; an empty table gives no rows; extra columns are not carried.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        oph = built(bins, bits, shingle)
        names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        waiting, of, out = None, None, []       # the row whose successor is still to come

        def row(i: int, text: str, own: bytes, following: str, following_fp: bytes) -> tuple:
            new = edited(text, following)
            fp = own if new == text else oph.fingerprint(new)
            return (i, len(text), hashlib.sha256(new.encode()).hexdigest(), own, fp,
                    oph.likeness(own, fp), oph.likeness(own, following_fp))

        for pdf in batches:
            for i, text, ahead, part in zip(pdf["_id"].tolist(), pdf["text"], pdf["ahead"].tolist(), pdf["part"].tolist()):
                if part != of:
                    waiting, of = None, part
                if ahead and waiting is None:
                    continue                    # a further row that shares the successor's id
                own = oph.fingerprint(text)
                if waiting is not None:
                    out.append(row(*waiting, text, own))
                waiting = None if ahead else (i, text, own)
                if len(out) >= 256:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    found = in_order(df, id_col, text_col).mapInPandas(
        run, "_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
             "near_edited double, near_next double")
    return found.select(real_id().alias("doc_id"), *found.columns[1:])
