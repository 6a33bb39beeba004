"""Substring de-duplication of words with an FM-index for each shard.

Every word that a repeated 13-word window covers goes, if the window also starts
in a document with a smaller id.  ``segments`` deals stretches of words that may
share a window into shards; a shard indexes its stretches (BWT in a wavelet matrix
of packed bit planes, document ids in suffix order) and streams the stretches'
positions through backward search: a match that ends at a position is extended to
the left for as long as it occurs in a document with a smaller id, which gives
the position's matching statistic, and the positions whose statistic reaches the
window's length are reported as intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from . import segments
from ._common import real_id, slices

WINDOW = 13         # words of a repeated window
GRAM = 5            # words of the sampled q-grams


class WaveletMatrix:
    """Rank of a symbol in a prefix of a sequence, by one packed bit plane for each
    bit of the symbols (the highest first), stably split by bit."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.n, self.levels = len(sequence), max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        now = sequence
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(np.uint8)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
            padded[:self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(self.n - int(ones.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before lo and before hi (lo <= hi)."""
        start = np.zeros(len(symbol), dtype=np.int64)       # of the symbol's block on the level
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            s, a, b = self._ones(k, start), self._ones(k, lo), self._ones(k, hi)
            start = np.where(one, self.zeros[k] + s, start - s)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return lo - start, hi - start


class FmIndex:
    """Over the sequences of a shard, each with its document's id.  ``depth`` bounds
    the length of patterns: suffixes are sorted by that many symbols."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, ids: np.ndarray, depth: int):
        """flat: symbols from 1 on, one sequence after the other; 0 ends a sequence."""
        place = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
        n = len(flat) + len(sizes)
        text = np.zeros(n, dtype=np.int64)
        text[place] = flat
        doc = np.repeat(ids, sizes + 1)
        self.sigma = int(text.max(initial=0)) + 1
        rank, reach = text.copy(), 1
        while reach < depth + 1:            # prefix doubling to the depth that patterns need
            later = np.concatenate([rank[reach:], np.zeros(min(reach, n), dtype=rank.dtype)])[:n]
            rank = np.unique(rank * (n + self.sigma) + later, return_inverse=True)[1]
            reach *= 2
        order = np.argsort(rank, kind="stable")
        self.bwt = WaveletMatrix(text[order - 1], self.sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.docs = np.concatenate([doc[order], [np.iinfo(np.int64).max]])
        self.n = n

    def lowest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest document id in each non-empty suffix range."""
        pair, where = np.unique(lo * (self.n + 1) + hi, return_inverse=True)
        cuts = np.column_stack([pair // (self.n + 1), pair % (self.n + 1)]).ravel()
        return np.minimum.reduceat(self.docs, cuts)[::2][where]

    def statistics(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """For each position ``ends`` of ``flat`` (exclusive end of a match that may not
        go left of ``starts``): the longest match, up to ``most``, that occurs in a
        document with an id smaller than ``ids``."""
        found = np.zeros(len(ends), dtype=np.int64)
        live = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.n, dtype=np.int64)
        for step in range(1, most + 1):
            live_ok = ends[live] - step >= starts[live]
            live, lo, hi = live[live_ok], lo[live_ok], hi[live_ok]
            if not len(live):
                break
            symbol = flat[ends[live] - step]
            a, b = self.bwt.rank(symbol, lo, hi)
            lo, hi = self.first[symbol] + a, self.first[symbol] + b
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
            if not len(live):
                break
            earlier = self.lowest(lo, hi) < ids[live]
            live, lo, hi = live[earlier], lo[earlier], hi[earlier]
            found[live] = step
        return found


def matched(ids: np.ndarray, bodies: list[bytes], window: int) -> np.ndarray:
    """For every window of the bodies, in order: whether it starts in a smaller document."""
    words = [b.split() for b in bodies]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    known: dict[bytes, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known) + 1) for x in words for w in x), dtype=np.int64, count=int(sizes.sum()))
    index = FmIndex(flat, sizes, ids, window)
    count = np.maximum(0, sizes - window + 1)
    base = np.repeat(np.cumsum(sizes) - sizes, count)
    starts = base + np.arange(len(base)) - np.repeat(np.cumsum(count) - count, count)
    return index.statistics(flat, starts, starts + window, np.repeat(ids, count), window) >= window


_SEEN: dict[bytes, int] = {}


def _symbols(text: str):
    words = text.encode().split()       # of bytes: ASCII white space only
    seen, digest = _SEEN, xxhash.xxh3_64_intdigest
    if len(seen) >= 200_000:
        seen.clear()
    out = []
    for w in words:
        h = seen.get(w)
        if h is None:
            h = digest(w)
            if len(w) <= 64 and len(seen) < 400_000:
                seen[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64), words


def _body(words: list[bytes], lo: int, hi: int) -> bytes:
    return b" ".join(words[lo:hi])


def spec(window: int = WINDOW, gram: int = GRAM, **sizes: int) -> segments.Spec:
    if window - gram > segments.REACH:
        raise ValueError(f"windows of {window} words need grams of {window - segments.REACH} words or more")
    return segments.Spec(window, gram, False, _symbols, _body,
                         lambda ids, starts, count, bodies: matched(ids, bodies, window), **sizes)


def removed(df: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
            bucket: int = segments.BUCKET, **sizes: int) -> DataFrame:
    """``(doc_id, n_words, spans array<struct<start, end>>, kept string)`` for every
    row: the maximal runs of words that a window with an equal one in a document of
    smaller id covers, and the other words, joined by a space.

    Null texts have no words; a null id is smaller than all others; rows that share
    an id count as one document, so they don't repeat each other; long documents
    are cut in pieces whose windows overlap; an empty table gives no rows; extra
    columns are not carried.
    """
    docs, found = segments.repeats(df, spec(window, gram, **sizes), id_col, text_col, bucket)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            out = []
            for i, text, tag, *spans in zip(pdf["_id"].tolist(), pdf["text"], pdf["tag"].tolist(),
                                            pdf["tags"], pdf["los"], pdf["his"]):
                words = text.encode().split()
                gone = segments.covered(*spans, tag, len(words), window)
                kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((i, len(words), [{"start": int(a), "end": int(b)} for a, b in zip(*segments.runs(gone))],
                            b" ".join(kept).decode()))
            yield pd.DataFrame(out, columns=["_id", "n_words", "spans", "kept"])

    return segments.joined(docs, found).mapInPandas(
        run, "_id long, n_words long, spans array<struct<start:int,end:int>>, kept string").select(
        real_id().alias("doc_id"), "n_words", "spans", "kept")
