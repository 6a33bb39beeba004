"""Repeated windows across documents: the distributed part that the suffix-array
and the FM-index operators share.

A window is ``window`` consecutive symbols (bytes or words) of one document.  Every
window chooses, by its content alone, an anchor: the q-gram with the smallest
hash inside it.  Windows that share an anchor form a *segment*, the stretch of
symbols they cover.  Equal windows choose equal q-grams at equal offsets, so only
segments in the same q-gram bucket can hold equal windows.

1. Tasks cut documents into segments, a few in a hundred symbols.  Of equal
   segments in a slice only the first goes on; the others repeat it.
2. The buckets are dealt out by q-gram.  Of equal segments the first stays, the
   others are repeats as a whole.  A segment that is alone in its bucket is done.
   A bucket that is full of different segments already within a slice sends all
   but two of them on by segment, so that a very common q-gram doesn't meet in
   one task.
3. Different segments of one bucket may still share some windows.  Their symbols
   are fetched by document and a resolver (given by the operator) finds the equal
   windows among them.  A bucket with more than ``BUCKET`` segments is resolved
   window by window instead, dealt out by the windows' hashes.
4. Repeated windows of a document are gathered by document.

Segments and windows are compared by 64-bit polynomial hashes together with their
bucket's 64-bit hash (or a second hash).  Texts move once, by document; the plan
reads that exchange twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import partitions, slices, stored, texts

SLICE = 1 << 20         # symbols that a task looks at together
BUCKET = 200_000        # segments of a bucket that one resolver call may get
REACH = 255             # symbols that a window may have besides its gram (``_pack``)
_AT = (1 << 24) - 1
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + (1 << 16))
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, dtype=np.uint64))])
                      for x in (_ODD, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass(frozen=True)
class Spec:
    """What a symbol is.  ``symbols``: text -> (uint64 values, raw symbols);
    ``body``: the symbols of a range as bytes; ``resolve``: (ids of segments, starts of
    all their windows, windows of each, bodies) -> which windows repeat an earlier
    one; ``within``: whether an earlier start in the same document counts."""
    window: int
    gram: int
    within: bool
    symbols: Callable[[str], tuple[np.ndarray, object]]
    body: Callable[[object, int, int], bytes]
    resolve: Callable[[np.ndarray, np.ndarray, np.ndarray, list[bytes]], np.ndarray]
    slice: int = SLICE          # symbols that a task looks at together
    wide: int = 2               # different segments of a bucket that a slice sends by q-gram
    block: int = 20_000         # segments of small buckets that are resolved together


class Hashed:
    """Rolling hashes of a run of symbols."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        power, self.inverse = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(values * power[:self.n], out=self.sums[1:])

    def spans(self, lo: np.ndarray, hi: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + np.uint64(salt))

    def grams(self, q: int) -> np.ndarray:
        n = self.n - q + 1
        return mix((self.sums[q:] - self.sums[:n]) * self.inverse[:n])


def _window_minimum(key: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    rest = width - step
    return np.minimum(key[:-rest], key[rest:]) if rest else key


def segments(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """(anchor, first window, last window, q-gram hash, segment hash) of all
    windows that lie inside one of the pieces ``starts[i]:ends[i]``."""
    none = tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    long = ends - starts >= window
    if not long.any():
        return none
    hashed = Hashed(values)
    grams = hashed.grams(gram)
    key = (grams & np.uint64(0xFFFFFFFFFFFFFFFF ^ _AT)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_window_minimum(key, window - gram + 1) & np.uint64(_AT)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, dtype=np.int32)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - window + 1, -1)
    p = np.nonzero(np.cumsum(inside[:-1]) > 0)[0]
    a = anchor[p]
    cut = np.ones(len(p), dtype=bool)
    cut[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.nonzero(cut)[0]
    lo, hi, at = p[first], p[np.append(first[1:], len(p)) - 1], a[first]
    whole = hashed.spans(lo, hi + window)
    return at, lo, hi, grams[at], mix(whole + (at - lo).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
                                      + (hi - lo).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


# -- 1. slices --------------------------------------------------------------
# place: anchor | windows before it | windows after the last one before it | text's tag
def _pack(at, lo, hi, tag):
    return (at << 32) | ((at - lo) << 24) | ((at - hi) << 16) | tag


def _unpack(place: np.ndarray):
    at = place >> 32
    return at, at - ((place >> 24) & 255), at - ((place >> 16) & 255), place & 0xFFFF


def _ranges(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Neighbouring and overlapping window ranges of a document joined."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    cut = np.ones(len(doc), dtype=bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)
    first = np.nonzero(cut)[0]
    return doc[first], lo[first], np.maximum.reduceat(hi, first)


def later(ids, at, first_id, first_at, within: bool) -> np.ndarray:
    return (ids > first_id) | ((ids == first_id) & (at > first_at)) if within else ids > first_id


_ROW = "kind int, route long, bucket long, segment long, _id long, place long"
_NAMES = ["kind", "route", "bucket", "segment", "_id", "place"]
OPEN, KNOWN, REPEAT = 0, 1, 2       # kinds: to be compared; its bucket is known to be shared; windows [bucket, segment] repeat


def _frame(kind, route, bucket, segment, ids, place) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(_NAMES, (np.asarray(x).astype(np.int32) if i == 0 else np.asarray(x).view(np.int64)
                                          for i, x in enumerate((kind, route, bucket, segment, ids, place))))))


def _slice_rows(spec: Spec, pieces: list[tuple[int, int, int, np.ndarray]]) -> Iterator[pd.DataFrame]:
    """pieces: (id, tag, offset in the document, values)."""
    sizes = np.array([len(v) for *_, v in pieces], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at, lo, hi, bucket, segment = segments(np.concatenate([v for *_, v in pieces]), starts, ends, spec.window, spec.gram)
    if not len(at):
        return
    piece = np.searchsorted(ends, lo, side="right")
    shift = np.array([o for _, _, o, _ in pieces], dtype=np.int64)[piece] - starts[piece]
    ids = np.array([i for i, *_ in pieces], dtype=np.int64)[piece]
    tag = np.array([t for _, t, *_ in pieces], dtype=np.int64)[piece]
    at, lo, hi = at + shift, lo + shift, hi + shift
    order = np.lexsort((at, ids, segment, bucket))
    at, lo, hi, bucket, segment, ids, tag = (x[order] for x in (at, lo, hi, bucket, segment, ids, tag))
    new_bucket = np.ones(len(at), dtype=bool)
    new_bucket[1:] = bucket[1:] != bucket[:-1]
    new = new_bucket.copy()
    new[1:] |= segment[1:] != segment[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    repeat = later(ids, at, ids[first], at[first], spec.within)
    if repeat.any():
        # a document's key here: its place among the slice's (id, tag) pairs
        pair, where = np.unique(np.column_stack([ids[repeat], tag[repeat]]), axis=0, return_inverse=True)
        d, a, b = _ranges(where.ravel(), lo[repeat], hi[repeat])
        yield _frame(np.full(len(d), REPEAT), mix(np.arange(len(d)).astype(np.uint64) ^ pair[d, 0].view(np.uint64)),
                     a, b, pair[d, 0], pair[d, 1])
    # how many different segments of its bucket come before a segment
    nth = np.cumsum(new) - 1
    nth = nth - nth[np.maximum.accumulate(np.where(new_bucket, np.arange(len(at)), 0))]
    keep = ~repeat
    far = (nth >= spec.wide)[keep]
    bucket, segment = bucket[keep], segment[keep]
    yield _frame(np.where(far, KNOWN, OPEN), np.where(far, mix(bucket ^ mix(segment)), bucket), bucket, segment,
                 ids[keep], _pack(at[keep], lo[keep], hi[keep], tag[keep]))


def _cut(spec: Spec):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in slices(batches):
            for i, tag, text in zip(pdf["_id"].tolist(), pdf["tag"].tolist(), pdf["text"]):
                values, _ = spec.symbols(text)
                # windows of a long document in pieces that overlap by a window less one
                for o in range(0, max(1, len(values) - spec.window + 1), spec.slice):
                    part = values[o:o + spec.slice + spec.window - 1]
                    if len(part) < spec.window:
                        continue
                    held.append((i, tag, o, part))
                    n += len(part)
                    if n >= spec.slice:
                        yield from _slice_rows(spec, held)
                        held, n = [], 0
        if held:
            yield from _slice_rows(spec, held)

    return run


# -- 2. buckets -------------------------------------------------------------
_FOUND = "edge boolean, _id long, bucket long, place long, lo int, hi int, tag int"


def _found(edge: bool, ids, bucket, place, lo, hi, tag) -> pd.DataFrame:
    return pd.DataFrame({"edge": np.full(len(ids), edge), "_id": ids, "bucket": bucket, "place": place,
                         "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "tag": tag.astype(np.int32)})


def _compare(spec: Spec):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (route, bucket, segment, _id, place)."""
        last = None                 # the previous row's (route, bucket, segment)
        rep = (0, 0)                # its segment's first (id, anchor)
        shared = False              # its bucket has two different segments
        waiting: list[tuple] = []   # the only segment so far of the bucket that may go on

        def edges(rows) -> pd.DataFrame:
            ids, bucket, place = (np.concatenate(x) for x in zip(*rows))
            _, lo, hi, tag = _unpack(place)
            return _found(True, ids, bucket, place, lo, hi, tag)

        for pdf in batches:
            kind, route, bucket, segment, ids, place = (pdf[c].to_numpy() for c in _NAMES)
            done = kind == REPEAT
            if done.any():
                yield _found(False, ids[done], bucket[done], place[done], bucket[done], segment[done], place[done])
                kind, route, bucket, segment, ids, place = (x[~done] for x in (kind, route, bucket, segment, ids, place))
            n = len(ids)
            if not n:
                continue
            new_bucket = np.ones(n, dtype=bool)
            new_bucket[1:] = (route[1:] != route[:-1]) | (bucket[1:] != bucket[:-1])
            new = new_bucket.copy()
            new[1:] |= segment[1:] != segment[:-1]
            new_bucket[0] = last is None or (route[0], bucket[0]) != last[:2]
            new[0] = new_bucket[0] or segment[0] != last[2]
            at, lo, hi, tag = _unpack(place)
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            first_id = np.where(first < 0, rep[0], ids[first])
            first_at = np.where(first < 0, rep[1], at[first])
            repeat = later(ids, at, first_id, first_at, spec.within)
            if repeat.any():
                yield _found(False, ids[repeat], bucket[repeat], place[repeat], lo[repeat], hi[repeat], tag[repeat])
            # buckets: runs of new_bucket; the first run may go on from before
            run_of = np.cumsum(new_bucket)              # 0: the run from before
            kinds = np.bincount(run_of, weights=new, minlength=run_of[-1] + 1)
            if kinds[0] > 0 or not new_bucket[0]:
                kinds[0] += 1                           # its segment that is in ``waiting`` or was sent
            several = kinds > 1
            several[0] |= shared
            if several[0] and not new_bucket[0] and waiting:
                yield edges(waiting)
                waiting = []
            if new_bucket.any():
                waiting = []                            # that bucket ended with one segment
            out = ~repeat & (several[run_of] | (kind == KNOWN))
            if out.any():
                yield edges([(ids[out], bucket[out], place[out])])
            tail = ~repeat & (run_of == run_of[-1]) & ~out
            if tail.any():
                waiting.append((ids[tail], bucket[tail], place[tail]))
            shared = bool(several[run_of[-1]])
            last = (route[-1], bucket[-1], segment[-1])
            rep = (first_id[-1], first_at[-1])

    return run


# -- 3. segments that share a bucket ----------------------------------------
_BODY = "kind int, route long, bucket long, _id long, place long, body binary"
_BODIES = ["kind", "route", "bucket", "_id", "place", "body"]
SEGMENT, WINDOW = 0, 1      # further kinds, besides REPEAT (windows [route, bucket] repeat)


def _fetch(spec: Spec):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            rows, windows = [], []
            for i, own, text, *found in zip(pdf["_id"].tolist(), pdf["tag"].tolist(), pdf["text"],
                                            pdf["place"], pdf["bucket"], pdf["hot"]):
                values, raw = spec.symbols(text)
                hashed = None
                for place, bucket, hot in zip(*(x.tolist() for x in found)):
                    at, lo, hi, tag = place >> 32, (place >> 32) - (place >> 24 & 255), (place >> 32) - (place >> 16 & 255), place & 0xFFFF
                    if tag != own or hi + spec.window > len(values):
                        continue                        # another text with this id
                    if not hot:
                        rows.append((SEGMENT, bucket, bucket, i, place, spec.body(raw, lo, hi + spec.window)))
                        continue
                    hashed = hashed or Hashed(values)
                    p = np.arange(lo, hi + 1)
                    one = hashed.spans(p, p + spec.window)
                    two = hashed.spans(p, p + spec.window, salt=0x5851F42D4C957F2D)
                    windows.append((one.view(np.int64), two.view(np.int64), np.full(len(p), i), _pack(p, p, p, tag)))
            if windows:
                one, two, ids, place = (np.concatenate(x) for x in zip(*windows))
                order = np.lexsort((place, ids, two, one))
                one, two, ids, place = (x[order] for x in (one, two, ids, place))
                new = np.ones(len(ids), dtype=bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
                again = later(ids, place >> 32, ids[first], (place >> 32)[first], spec.within)
                yield pd.DataFrame({"kind": np.where(again, REPEAT, WINDOW).astype(np.int32),
                                    "route": np.where(again, place >> 32, one), "bucket": np.where(again, place >> 32, two),
                                    "_id": ids, "place": place, "body": [b""] * len(ids)})
            for k in range(0, len(rows), 8192):
                yield pd.DataFrame(rows[k:k + 8192], columns=_BODIES).astype({"kind": np.int32})

    return run


_SPAN = "_id long, tag int, lo int, hi int"


def _span_frame(ids, tag, lo, hi) -> pd.DataFrame:
    return pd.DataFrame({"_id": np.asarray(ids, dtype=np.int64), "tag": np.asarray(tag, dtype=np.int32),
                         "lo": np.asarray(lo, dtype=np.int32), "hi": np.asarray(hi, dtype=np.int32)})


def repeated(spec: Spec, ids: np.ndarray, place: np.ndarray, bodies: list[bytes]) -> pd.DataFrame:
    """Spans of the windows of these segments that repeat an earlier one."""
    _, lo, hi, tag = _unpack(place)
    count = hi - lo + 1
    row = np.repeat(np.arange(len(ids)), count)
    p = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lo[row]
    again = spec.resolve(ids, p, count, bodies)
    d, a, b = _ranges(row[again], p[again], p[again])
    return _span_frame(ids[d], tag[d], a, b)


def _resolve(spec: Spec):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by (kind, route, bucket, _id, place)."""
        held, n = [], 0             # whole buckets, then the one that may go on
        last = first = None         # of windows: the previous key and its first (id, start)

        def block():
            pdf = pd.concat(held) if len(held) > 1 else held[0]
            return repeated(spec, pdf["_id"].to_numpy(), pdf["place"].to_numpy(), pdf["body"].tolist())

        for pdf in batches:
            for kind in (REPEAT, WINDOW):
                part = pdf[pdf["kind"].to_numpy() == kind]
                if not len(part):
                    continue
                ids, place = part["_id"].to_numpy(), part["place"].to_numpy()
                at, _, _, tag = _unpack(place)
                if kind == WINDOW:
                    one, two = part["route"].to_numpy(), part["bucket"].to_numpy()
                    new = np.ones(len(ids), dtype=bool)
                    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                    new[0] = (one[0], two[0]) != last
                    at_first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
                    fi = np.where(at_first < 0, first[0] if first else 0, ids[at_first])
                    fa = np.where(at_first < 0, first[1] if first else 0, at[at_first])
                    last, first = (one[-1], two[-1]), (fi[-1], fa[-1])
                    again = later(ids, at, fi, fa, spec.within)
                    ids, tag, at = ids[again], tag[again], at[again]
                if len(ids):
                    yield _span_frame(ids, tag, at, at)
            part = pdf[pdf["kind"].to_numpy() == SEGMENT]
            if not len(part):
                continue
            bucket = part["bucket"].to_numpy()
            if n >= spec.block:          # resolve at the next border between buckets
                before = held[-1]["bucket"].iloc[-1]
                border = int(np.argmax(bucket != before)) if (bucket != before).any() else len(part)
                if border:
                    held.append(part.iloc[:border])
                    n += border
                if border < len(part):
                    yield block()
                    held, n = [part.iloc[border:]], len(part) - border
            else:
                held.append(part)
                n += len(part)
        if held:
            yield block()

    return run


# -- all --------------------------------------------------------------------
def repeats(df: DataFrame, spec: Spec, id_col: str = "doc_id", text_col: str = "text",
            bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(documents ``(_id, text, tag)``, their repeated windows ``(_id, spans)``),
    ``spans`` an array of (tag, lo, hi): the windows that start from lo to hi."""
    n = partitions(df.sparkSession)
    docs = texts(df, id_col, text_col).withColumn("tag", F.xxhash64("text").bitwiseAND(0xFFFF).cast("int"))
    rows = docs.mapInPandas(_cut(spec), _ROW).repartition(n, "route").sortWithinPartitions(
        "route", "bucket", "segment", "_id", "place")
    found = stored(rows.mapInPandas(_compare(spec), _FOUND), "segments")
    edges = found.where("edge").select("_id", "bucket", "place")
    hot = edges.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
    marked = edges.join(hot, "bucket", "left").select("_id", F.struct("place", "bucket", F.col("n").isNotNull().alias("hot")).alias("x"))
    wanted = marked.groupBy("_id").agg(F.collect_list("x").alias("found"))      # of one document
    bodies = (docs.join(wanted, "_id").select("_id", "text", "tag", "found.place", "found.bucket", "found.hot")
              .mapInPandas(_fetch(spec), _BODY))
    spans = (bodies.repartition(n, "route").sortWithinPartitions("kind", "route", "bucket", "_id", "place")
             .mapInPandas(_resolve(spec), _SPAN))
    every = found.where("not edge").select("_id", "tag", "lo", "hi").unionByName(spans)
    return docs, every.groupBy("_id").agg(F.collect_list(F.struct("tag", "lo", "hi")).alias("spans"))


def joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with their spans as three arrays (null: none)."""
    both = docs.join(found, "_id", "left")
    return both.select("_id", "text", "tag", *(F.col(f"spans.{c}").alias(c2) for c, c2 in
                                               (("tag", "tags"), ("lo", "los"), ("hi", "his"))))


def covered(tags, los, his, tag: int, n: int, window: int) -> np.ndarray:
    """Which of a document's n symbols a repeated window covers."""
    edge = np.zeros(n + 1, dtype=np.int32)
    if tags is not None and len(tags):
        lo, hi = np.asarray(los, dtype=np.int64), np.asarray(his, dtype=np.int64) + window
        own = (np.asarray(tags) == tag) & (hi <= n)
        np.add.at(edge, lo[own], 1)
        np.add.at(edge, hi[own], -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered runs."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
