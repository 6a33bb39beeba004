"""Quality classifier by co-training of two views of a document.

The content view sees the shapes of the text: counts of character-class pairs
and how much neighbouring words repeat.  The page view sees metadata only: the
row's source, language and length, and the layout (lines, word lengths, shares of
distinct words, letters, capitals, digits and signs).  Both are logistic models.
In every round each model labels all documents without a label, and of those it is
most sure of, some of either kind join the *other* model's training rows.  Each
view is then calibrated (Platt) on labelled rows that neither trained on, and
the score is the mean of the calibrated log-odds, weighted by each view's skill.

Both views' features of every document are written once; a round reads them twice,
to count the documents by margin and to draw from those beyond the two margins
found.  A view is fitted in one task, on a bounded sample of labelled rows
(``LABELLED``) and of rows labelled by the other view (``ADDED`` a round), chosen by
a hash.  The driver sees weights and counts only; the scores cover every document.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, slices, stored

LABELLED = 6_000                # labelled rows that the models are fitted on, at most (about)
ROUNDS, SHARE = 4, 0.08         # co-training rounds; part of all other rows that a view may label in a round
ADDED = 400                     # rows that join a view's training rows in a round, at most (about)
CALIBRATION = 0.25              # part of the labelled rows kept for calibration
THRESHOLD = 0.5

_BINS, _EDGE = 1_200, 30.0       # margins are counted in bins from -30 to 30
_SURE = math.log(9)             # a margin beyond this is a probability below 0.1 or above 0.9

_CLASSES = 24
_HASHED = 64                    # slots of the one-hot metadata


def _class_table() -> np.ndarray:
    """Byte -> character class: signs keep their own class as far as there is room."""
    table = np.full(256, 0, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = 1
        elif c.islower():
            table[b] = 2
        elif c.isupper():
            table[b] = 3
        elif c.isdigit():
            table[b] = 4
        elif c == "\n":
            table[b] = 5
        elif c.isspace():
            table[b] = 6
        elif not c.isprintable():
            table[b] = 7
        else:
            table[b] = 8 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".index(c) % 16
    return table


_TABLE = _class_table()


def content(text: str) -> np.ndarray:
    """Square roots of the shares of class pairs; repetition of words."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    out = np.zeros(_CLASSES * _CLASSES + 4, dtype=np.float32)
    if len(raw) > 1:
        c = _TABLE[raw]
        out[:-4] = np.sqrt(np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES) / (len(raw) - 1))
    words = text.split()
    if len(words) > 1:
        out[-4] = sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1)
        out[-3] = sum(a == b for a, b in zip(words, words[2:])) / len(words)
    out[-2] = float(len(words) == 0)
    out[-1] = min(1.0, len(words) / 20)
    return out


def _slot(name: str, value: object) -> int:
    return zlib.crc32(f"{name}={value}".encode()) % _HASHED


def page(text: str, source: object, lang: object, n_chars: object) -> np.ndarray:
    out = np.zeros(_HASHED + 14, dtype=np.float32)
    out[_slot("source", source)] = out[_slot("lang", lang)] = 1.0
    n, words, lines = max(1, len(text)), text.split(), text.split("\n")
    size = float(n_chars) if n_chars is not None and not (isinstance(n_chars, float) and math.isnan(n_chars)) else n
    letters = sum(map(str.isalpha, words)) / max(1, len(words))         # words of letters only
    upper = sum(map(str.isupper, words)) / max(1, len(words))
    ends = sum(w[-1].isalnum() for w in words) / max(1, len(words))
    lengths = [len(w) for w in words] or [0]
    out[_HASHED:] = (
        math.log1p(abs(size)) / 10, math.log1p(len(words)) / 10, math.log1p(len(lines)) / 5, math.log1p(n / len(lines)) / 10,
        len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines), sum(lengths) / len(lengths) / 10,
        max(lengths) / 50 if max(lengths) < 50 else 1.0, letters, upper, ends, len(words) / n,
        sum(len(w) == 1 for w in words) / max(1, len(words)), sum(w[0].isupper() for w in words) / max(1, len(words)))
    return out


# -- models -----------------------------------------------------------------
@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0          # Platt calibration
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -12, 12)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 300) -> View:
    """Ridge logistic regression by accelerated gradient steps on scaled features, in single precision."""
    mean = x.mean(axis=0, dtype=np.float64)
    scale = np.maximum(x.std(axis=0, dtype=np.float64), 1e-3)
    z = (x - mean.astype(np.float32)) / scale.astype(np.float32)
    y = np.asarray(y, dtype=np.float32)
    n = max(1, len(y))
    top = np.ones(z.shape[1], np.float32)           # power iteration for the largest curvature
    for _ in range(30):
        top = z.T @ (z @ top)
        top /= np.float32(max(float(np.linalg.norm(top)), 1e-12))
    rate = np.float32(3.6 / (float(np.linalg.norm(z @ top)) ** 2 / n + ridge / n + 1.0))
    w = v = np.zeros(z.shape[1], np.float32)
    b = u = np.float32(0.0)
    for k in range(steps):
        p = _sigmoid(z @ v + u).astype(np.float32) - y
        w2, b2 = v - rate * (z.T @ p + np.float32(ridge) * v) / np.float32(n), u - rate * p.mean()
        m = np.float32(k / (k + 3))
        v, u, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    return View(mean, scale, w.astype(np.float64), float(b))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> float:
    """Platt's slope and shift; returns the view's skill (gain in log loss over the base share)."""
    if len(set(y.tolist())) < 2:
        return 1.0
    z = view.raw(x)
    unit = max(float(z.std()), 1e-6)
    one, zero = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (one + 1) / (one + 2), 1 / (zero + 2))      # smoothed targets
    a, pull = np.column_stack([z / unit, np.ones(len(z))]), 1e-2
    loss = lambda w: float((np.logaddexp(0, a @ w) - t * (a @ w)).sum() + pull * (w @ w) / 2)
    w = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull * np.eye(2), a.T @ (t - p) - pull * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    view.slope, view.shift = float(max(w[0], 0.0)) / unit, float(w[1])
    p = np.clip(_sigmoid(view.logit(x)), 1e-6, 1 - 1e-6)
    base = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    return float(max(0.02, 1 - loss / -(base * np.log(base) + (1 - base) * np.log(1 - base))))


@dataclass
class Model:
    views: tuple[View, View] | None
    share: float = 0.5          # of the content view

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.ones(len(a))
        return _sigmoid(self.share * self.views[0].logit(a) + (1 - self.share) * self.views[1].logit(b))


def fitted(known: tuple[np.ndarray, np.ndarray], added: tuple[np.ndarray, np.ndarray], held: float = CALIBRATION,
           calibrated: bool = False) -> tuple[View, float, float] | None:
    """A view, the share of good rows and the view's skill (1 unless ``calibrated``), from (features, labels) of labelled
    rows in an order free of the labels, and of added ones; none if a label does not occur."""
    x, y = known
    if len(set(y.tolist())) < 2:
        return None
    cut = max(1, int(len(y) * (1 - held)))
    if len(set(y[:cut].tolist())) < 2:
        cut = len(y)
    view = fit(np.concatenate([x[:cut], added[0]]), np.concatenate([y[:cut], added[1]]))
    own = slice(cut, None) if cut < len(y) else slice(None)
    return view, float(y[:cut].mean()), calibrate(view, x[own], y[own]) if calibrated else 1.0


# -- DataFrames -------------------------------------------------------------
def _inputs(text_col: str, source_col: str, lang_col: str, size_col: str) -> list[Column]:
    return [F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(source_col).cast("string"),
            F.col(lang_col).cast("string"), F.col(size_col).cast("double")]


def _views(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = list(pdf[["text", "source", "lang", "n_chars"]].itertuples(index=False, name=None))
    return (np.stack([content(t) for t, *_ in rows]),
            np.stack([page(t, s if isinstance(s, str) else None, g if isinstance(g, str) else None, n) for t, s, g, n in rows]))


_ROWS = "key long, y int, a binary, b binary"


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype(np.float32).tobytes(), 1)         # most shares are zero


def _block(packed: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(zlib.decompress, packed)), dtype=np.float32).reshape(len(packed), width)


_WIDTHS = (_CLASSES * _CLASSES + 4, _HASHED + 14)


def features(rows: DataFrame) -> DataFrame:
    """``(key, y, a, b)``: both views' features of rows ``(key, y, text, source, lang, n_chars)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            a, b = _views(pdf)
            yield pd.DataFrame({"key": pdf["key"], "y": pdf["y"], "a": [_packed(x) for x in a], "b": [_packed(x) for x in b]})
        pa.default_memory_pool().release_unused()

    return rows.mapInPandas(run, _ROWS)


def _fit(known: DataFrame, added: list[DataFrame], calibrated: bool) -> list[tuple[View, float, float]] | None:
    """Both views, each fitted in a task of its own."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("view"), F.col("a").alias("x")), F.struct(F.lit(1).alias("view"), F.col("b").alias("x"))))
    rows = known.select("key", "y", sides.alias("side")).select("side.view", F.lit(False).alias("extra"), "key", "y", "side.x")
    for more in added:
        rows = rows.unionByName(more)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = int(pdf["view"].iloc[0])
        pdf = pdf.sort_values(["key", "y", "x"])
        parts = [(_block(p["x"], _WIDTHS[v]), p["y"].to_numpy(np.int64)) for p in (pdf[~pdf["extra"]], pdf[pdf["extra"]])]
        got = fitted(*parts, calibrated=calibrated)
        return pd.DataFrame([(v, pickle.dumps(got))], columns=["view", "model"])

    got = {r["view"]: pickle.loads(r["model"]) for r in rows.groupBy("view").applyInPandas(run, "view int, model binary").collect()}
    return [got[0], got[1]] if got.get(0) and got.get(1) else None


def _margin_bin(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + _EDGE) / (2 * _EDGE) * _BINS), 0, _BINS - 1).astype(np.int64)


def _label_counts(pool: DataFrame, views: list[View]) -> np.ndarray:
    """Of each view, the number of pool rows in each bin of its margin."""
    shared = pool.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, _BINS), np.int64)
        for pdf in batches:
            for v, c in enumerate("ab"):
                n[v] += np.bincount(_margin_bin(shared.value[v].raw(_block(pdf[c], _WIDTHS[v]))), minlength=_BINS)
        at = np.argwhere(n)
        yield pd.DataFrame({"view": at[:, 0].astype(np.int32), "bin": at[:, 1], "n": n[at[:, 0], at[:, 1]]})

    out = np.zeros((2, _BINS), np.int64)
    for r in pool.mapInPandas(run, "view int, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():
        out[r["view"], r["bin"]] = r["n"]
    return out


def _limits(counts: np.ndarray, share: float, added: int, good: float) -> tuple[int, float, int, float]:
    """The last bin of rows to call bad and the first to call good, each with the part of its rows to draw."""
    total, low_sure, high_sure = counts.sum(), _margin_bin(np.array([-_SURE]))[0], _margin_bin(np.array([_SURE]))[0] + 1
    up, down = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    low = min(int(np.searchsorted(up, share * total * (1 - good))), low_sure - 1)
    high = max(_BINS - 1 - int(np.searchsorted(down[::-1], share * total * good)), high_sure)
    part = lambda n, quota: min(1.0, quota / max(1, int(n)))
    return (low, part(up[low], added * (1 - good)), high, part(down[high] if high < _BINS else 0, added * good))


def _labelled_by_the_other(pool: DataFrame, views: list[View], limits: list[tuple], round_: int) -> DataFrame:
    """``(view, extra, key, y, x)``: rows that one view labels, with the other view's features."""
    shared = pool.sparkSession.sparkContext.broadcast((views, limits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        views, limits = shared.value
        for pdf in batches:
            key = pdf["key"].to_numpy().astype(np.uint64)
            for v, (own, other) in enumerate(("ab", "ba")):
                low, some_low, high, some_high = limits[v]
                at = _margin_bin(views[v].raw(_block(pdf[own], _WIDTHS[v])))
                draw = ((key + np.uint64(2 * round_ + v)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
                for y, chosen in ((0, (at <= low) & (draw < some_low)), (1, (at >= high) & (draw < some_high))):
                    part = pdf[chosen]
                    yield pd.DataFrame({"view": np.full(len(part), 1 - v, np.int32), "extra": np.full(len(part), True), "key": part["key"],
                                        "y": np.full(len(part), y, np.int32), "x": part[other]})

    return pool.mapInPandas(run, "view int, extra boolean, key long, y int, x binary")


def cotrain(known: DataFrame, pool: DataFrame, rounds: int = ROUNDS, share: float = SHARE, added: int = ADDED) -> Model:
    """``known``: a bounded sample of labelled rows; ``pool``: all other rows, of any number; both ``features``."""
    extra: list[DataFrame] = []
    for r in range(rounds + 1):
        got = _fit(known, extra, calibrated=r == rounds)
        if got is None:
            return Model(None)
        if r < rounds:
            views = [view for view, _, _ in got]
            limits = [_limits(n, share, added, good) for n, (_, good, _) in zip(_label_counts(pool, views), got)]
            extra.append(stored(_labelled_by_the_other(pool, views, limits, r), "labelled"))
    return Model((got[0][0], got[1][0]), got[0][2] / (got[0][2] + got[1][2]))


def train(df: DataFrame, labels: DataFrame, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", label_col: str = "quality") -> Model:
    """Fits on at most about ``labelled`` labelled rows, one for an id, and labels all others in rounds.

    Null labels and ids of labels are left out; repeated labels of an id count once (the
    smallest), repeated rows of a labelled id too (the smallest); repeated rows of other ids are rows
    like others.  Null metadata is a value of its own, null text empty.  With no rows
    of one of the two labels, as with an empty table, every document scores 1.
    """
    bounded_batches(df.sparkSession)
    marked = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)))
    part = min(1.0, labelled / max(1, marked.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000))
    # a sample of bounded size, two numbers a row: both joins may broadcast it
    chosen = F.broadcast(marked.where(draw < int(part * 1_000_000)).groupBy("doc_id").agg(F.min("y").alias("y")))
    text, source, lang, size = _inputs(text_col, source_col, lang_col, size_col)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), source.alias("source"),
                     lang.alias("lang"), size.alias("n_chars"))
    # a repeated id may hold a third of all rows: the smallest row stands for it
    fields = ("text", "source", "lang", "n_chars")
    one = docs.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*fields)).alias("row"))
    key = F.xxhash64("doc_id", *fields)
    known = stored(features(one.select("doc_id", "y", "row.*").select(key.alias("key"), "y", *fields)), "labelled")
    rest = docs.join(chosen, "doc_id", "left_anti")
    pool = stored(features(rest.select(key.alias("key"), F.lit(-1).alias("y"), *fields)), "features")
    return cotrain(known, pool)


def score(df: DataFrame, model: Model, text_col: str = "text", source_col: str = "source",
          lang_col: str = "lang", size_col: str = "n_chars") -> Column:
    """The score of ``df``'s rows as a column: 0 to 1, higher is better.  Null text
    counts as empty, null metadata as a value of its own; long texts are read whole."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)      # two weight vectors

    @F.pandas_udf("double")
    def run(text: pd.Series, source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.Series:
        pdf = pd.DataFrame({"text": text, "source": source, "lang": lang, "n_chars": size})
        out = [shared.value.score(*_views(part)) for part in slices(iter([pdf]))]
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return run(*_inputs(text_col, source_col, lang_col, size_col))


def scored(df: DataFrame, model: Model, name: str = "quality_score", **columns: str) -> DataFrame:
    """Every row with all its columns and its score; a column of that name is
    replaced; an empty table stays empty."""
    return df.withColumn(name, score(df, model, **columns))


def accepted(df: DataFrame, model: Model, threshold: float = THRESHOLD, **columns: str) -> DataFrame:
    """The rows that score at least ``threshold``, with their own columns only."""
    judged = df.select(F.struct("*").alias("row"), score(df, model, **columns).alias("score"))
    return judged.where(F.col("score") >= threshold).select("row.*")
