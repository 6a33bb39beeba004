"""Toxicity scores: a learned lexicon in a trie, met by Levenshtein automata.

The lexicon is learned from labelled rows, copies counted once: words, and stems
(beginnings of longer words), that toxic documents have far more often than
chance among all terms would give.  A word of a text is run as a Levenshtein
automaton (one row of edit distances as its state) down the trie; branches whose
state is dead are not entered, so misspelled terms are found without listing
variants.  How much a matched spelling says is learned as well, so that a clean
word one letter away from a term, or a clean form of a stem, stays clean.

A hit's weight is scaled by its context: between quotation marks, or near words
that report or discuss speech, it counts less.  A logistic model over the hits'
sum, number and maximum gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import oph
from ._common import real_id, slices, stored, texts

TRAIN_ROWS = 12_000     # labelled rows that the lexicon is learned from, at most (about: chosen by hash)
TERMS = 512             # terms of the lexicon, at most
SPELLINGS = 20_000      # spellings with a trust of their own, at most
CANDIDATES = 4_000      # terms that are looked at, the most frequent ones
EVIDENCE = 14.0         # log-likelihood gain of a term, at least: chance among a million terms
STEM = (4, 10)          # lengths of stems
WINDOW = 8              # words of context on either side
THRESHOLD = 0.3

WORD = re.compile(r"[\w@$]+")
# digits and signs that stand for letters
LEET = str.maketrans("013457@$", "oieastas")
# words that report or discuss speech, in the languages of the tables
REPORTING = frozenset("""said says saying wrote writes called calls quote quoted quotes quoting word words term terms slur
insult insults sagte sagt schrieb nannte zitat wort dijo dice escribió llamó cita palabra dit disait écrit appelé citation mot""".split())
OPENING, CLOSING = "\"“„«‘", "\"”“»’"


def normal(word: str) -> str:
    return word.translate(LEET) if not word.isalpha() and any(c.isalpha() for c in word) else word


# -- automaton and trie -----------------------------------------------------
class _Node:
    __slots__ = ("kids", "terms")

    def __init__(self):
        self.kids: dict[str, _Node] = {}
        self.terms: list[tuple[str, bool, int]] = []     # (term, is a stem, edits allowed)


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """Terms (``True``: a stem, which begins longer words) in a trie."""

    def __init__(self, terms: dict[str, bool]):
        self.root, self.parts = _Node(), {}
        for term, stem in terms.items():
            node = self.root
            for c in term:
                node = node.kids.setdefault(c, _Node())
            k = edits_for(term)
            node.terms.append((term, stem, k))
            # of k + 1 parts of a term at least one survives k edits, at most k places off
            cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                for at in range(max(0, a - k), a + k + 1):
                    self.parts.setdefault((at, b - a), set()).add(term[a:b])
        self.most = max((edits_for(t) for t in terms), default=0)

    def __call__(self, word: str) -> tuple[str, int] | None:
        """The term that is nearest to the word, with its edits."""
        if not any(word[at:at + n] in found for (at, n), found in self.parts.items()):
            return None
        best: tuple[int, int, str] | None = None
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            for term, stem, k in node.terms:
                d = min(row[:-1], default=k + 1) if stem else row[-1]
                if d <= k and (best is None or (d, -len(term), term) < best):
                    best = (d, -len(term), term)
            for c, kid in node.kids.items():
                new = [row[0] + 1]
                for j, w in enumerate(word):
                    new.append(min(row[j] + (w != c), row[j + 1] + 1, new[j] + 1))
                if min(new) <= self.most:
                    stack.append((kid, new))
        return (best[2], best[0]) if best else None


# -- learned lexicon --------------------------------------------------------
@dataclass
class Lexicon:
    terms: dict[str, bool] = field(default_factory=dict)
    by_term: dict[tuple[str, int], tuple[int, int]] = field(default_factory=dict)    # (toxic, clean) by term and edits
    by_word: dict[str, tuple[int, int]] = field(default_factory=dict)                # (toxic, clean) by spelling
    base: float = 0.05                                                               # share of toxic rows
    model: tuple[float, ...] = (-3.0, 1.0, 0.0, 0.0)                                 # bias, sum, number, maximum


def _logit(p: float) -> float:
    return math.log(p / (1.0 - p))


def _terms_of(text: str) -> set[str]:
    words = {normal(w) for w in WORD.findall(text.lower())}
    seen = {w[:k] for w in words for k in range(STEM[0], min(len(w) - 1, STEM[1]) + 1)}
    seen.update(w + "$" for w in words if len(w) >= STEM[0])
    return seen


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in slices(batches):
        count = {0: Counter(), 1: Counter()}
        for text, toxic in zip(pdf["text"], pdf["toxic"].tolist()):
            count[int(toxic)].update(_terms_of(text))
        keys = [*count[0].keys() | count[1].keys()]
        yield pd.DataFrame({"term": keys, "clean": [count[0][k] for k in keys], "toxic": [count[1][k] for k in keys]})


def _spellings(matcher: Matcher):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str, int] | None] = {}
        for pdf in slices(batches):
            count: dict[tuple, list[int]] = {}
            for text, toxic in zip(pdf["text"], pdf["toxic"].tolist()):
                for w in set(WORD.findall(text.lower())):
                    if w not in known:
                        if len(known) >= 300_000:
                            known.clear()
                        known[w] = matcher(normal(w))
                    if (hit := known[w]) is not None:
                        count.setdefault((w, *hit), [0, 0])[int(toxic)] += 1
            if count:
                yield pd.DataFrame([(*k, *v) for k, v in count.items()],
                                   columns=["word", "term", "edits", "clean", "toxic"])

    return run


def sample(df: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic", train: Column | None = None) -> DataFrame:
    """``(text, toxic)`` of at most about ``rows`` labelled documents, chosen by a
    hash of the id; ``train`` says which ids labels may be learned from."""
    marked = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
              .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()))
    if train is not None:
        marked = marked.where(train)
    share = min(1.0, rows / max(1, marked.count()))
    chosen = (marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    def marked_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = oph.Oph()
        for pdf in slices(batches):
            hashes = [sketch.shingles(t) for t in pdf["text"]]
            yield pd.DataFrame({"text": pdf["text"], "toxic": pdf["toxic"], **{
                f"m{k}": [int((h ^ sketch.salt[k]).min() >> np.uint64(1)) if len(h) else k for h in hashes] for k in (0, 1)}})

    # the broadcast side has at most about ``rows`` rows of two numbers
    found = texts(df, id_col, text_col).join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select("text", "toxic")
    once = found.mapInPandas(marked_text, "text string, toxic int, m0 long, m1 long")
    return stored(once.dropDuplicates(["m0", "toxic"]).dropDuplicates(["m1", "toxic"]).select("text", "toxic"), "labelled")


def _evidence(toxic: int, clean: int, base: float) -> float:
    """Log-likelihood gain of a term's own toxic share over the base share."""
    n, p = toxic + clean, toxic / (toxic + clean)
    if p <= base:
        return 0.0
    return toxic * math.log(p / base) + (clean * math.log((1 - p) / (1 - base)) if clean else 0.0) if n else 0.0


def learn(rows: DataFrame, terms: int = TERMS, spellings: int = SPELLINGS) -> Lexicon:
    """From ``rows(text, toxic)``, a bounded sample.  Without rows of both kinds: an empty lexicon."""
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = total.get(1, 0), total.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    base = n_toxic / (n_toxic + n_clean)
    per = rows.mapInPandas(_counted, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # the share must be well above the base; the list is cut at its most frequent terms
    likely = per.where((F.col("toxic") >= 3) & (F.col("toxic") >= 3 * base * (F.col("toxic") + F.col("clean"))))
    gains = {r["term"]: _evidence(r["toxic"], r["clean"], base)
             for r in likely.orderBy(F.desc("toxic"), "clean", "term").limit(CANDIDATES).collect()}
    chosen: dict[str, bool] = {}
    starts: set[str] = set()            # beginnings of all chosen terms
    for t, gain in sorted(gains.items(), key=lambda x: (-round(x[1], 6), -len(x[0]), x[0])):
        word = t.rstrip("$")
        if gain < EVIDENCE or len(chosen) == terms:
            break
        if word in starts or any(chosen.get(word[:k]) for k in range(STEM[0], len(word) + 1)):
            continue                    # a stem has it, or it only has a chosen term inside
        chosen[word] = not t.endswith("$")
        starts.update(word[:k] for k in range(len(word) + 1))
    hits = rows.mapInPandas(_spellings(Matcher(chosen)), "word string, term string, edits int, clean long, toxic long")
    words = stored(hits.groupBy("word", "term", "edits").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "spellings")
    pair = lambda r: (r["toxic"], r["clean"])
    lexicon = Lexicon(
        chosen,
        {(r["term"], r["edits"]): pair(r) for r in words.groupBy("term", "edits")
         .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()},
        {r["word"]: pair(r) for r in words.orderBy(F.desc(F.col("clean") + F.col("toxic")), "word").limit(spellings).collect()},
        base)
    seen = rows.mapInPandas(_features(lexicon), "toxic int, total double, number double, most double").collect()
    lexicon.model = _fit(np.array([[r["total"], r["number"], r["most"]] for r in seen]), np.array([r["toxic"] for r in seen]))
    return lexicon


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps; three features and a bias."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pull = np.zeros(x.shape[1]), np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(lexicon)
        for pdf in slices(batches):
            toxic = pdf["toxic"].tolist()
            x = [scorer.features(scorer.hits(t, int(y))) for t, y in zip(pdf["text"], toxic)]
            yield pd.DataFrame(x, columns=["total", "number", "most"]).assign(toxic=toxic)[["toxic", "total", "number", "most"]]

    return run


# -- scoring ----------------------------------------------------------------
class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.match = lexicon, Matcher(lexicon.terms)
        self.known: dict[str, tuple[str, int] | None] = {}

    def found(self, w: str) -> tuple[str, int] | None:
        got = self.known.get(w, 0)
        if got == 0:
            if len(self.known) >= 300_000:
                self.known.clear()
            got = self.known[w] = self.match(normal(w))
        return got

    def weight(self, w: str, hit: tuple[str, int], without: int | None = None) -> float:
        """Log-odds over the base share; ``without`` leaves one row of that label out."""
        lex = self.lexicon
        less = (without == 1, without == 0)
        toxic, clean = (max(0, n - d) for n, d in zip(lex.by_term.get(hit, (0, 0)), less))
        # an unseen misspelling of a term is half as likely toxic as not
        p = (toxic + 0.5) / (toxic + clean + 1) if toxic + clean else 0.33 if hit[1] else 0.5
        toxic, clean = (max(0, n - d) for n, d in zip(lex.by_word.get(w, (0, 0)), less))
        p = (toxic + 2 * p) / (toxic + clean + 2)
        return _logit(min(0.999, max(0.001, p))) - _logit(lex.base)

    def hits(self, text: str, without: int | None = None) -> list[tuple[int, int, str, int, str, float]]:
        """(start, end, term, edits, word, weight by context) of every hit."""
        low = text.lower()
        if not any([self.found(w) is not None for w in WORD.findall(low)]):
            return []
        out, spans = [], list(WORD.finditer(low))
        for i, m in enumerate(spans):
            if (hit := self.found(m[0])) is None:
                continue
            near = spans[max(0, i - WINDOW):i + WINDOW + 1]
            before, after = low[near[0].start():m.start()], low[m.end():near[-1].end()]
            quoted = any(b in after and (before.count(a) % 2 if a == b else before.count(a) > before.count(b))
                         for a, b in zip(OPENING, CLOSING))
            told = any(x[0] in REPORTING for x in near)
            factor = 0.2 if quoted and told else 0.6 if quoted else 0.9 if told else 1.0
            weight = self.weight(m[0], hit, without)
            out.append((m.start(), m.end(), *hit, m[0], weight * factor if weight > 0 else weight))
        return out

    @staticmethod
    def features(hits: list[tuple]) -> tuple[float, float, float]:
        best: dict[str, float] = {}         # a repeated word counts once, at its strongest
        for *_, word, weight in hits:
            best[word] = max(best.get(word, weight), weight)
        up = [w for w in best.values() if w > 0]
        return min(20.0, sum(up)), float(min(len(up), 8)), max(up, default=0.0)

    def score(self, hits: list[tuple]) -> float:
        z = sum(w * x for w, x in zip(self.lexicon.model, (1.0, *self.features(hits))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, hits array<struct<start, end, term, edits, word, weight>>)`` for every row.

    Null and empty texts have no hits and the lexicon's base score; every text is
    read whole; rows are independent; an empty table gives no rows; extra columns
    are not carried.  The lexicon is broadcast: its size is bounded by ``TERMS``
    and ``SPELLINGS``.
    """
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in slices(batches):
            hits = [scorer.hits(t) for t in pdf["text"]]
            yield pd.DataFrame({"_id": pdf["_id"], "score": [scorer.score(h) for h in hits],
                                "hits": [[dict(zip(("start", "end", "term", "edits", "word", "weight"), x)) for x in h] for h in hits]})

    return texts(df, id_col, text_col).mapInPandas(
        run, "_id long, score double, hits array<struct<start:int,end:int,term:string,edits:int,word:string,weight:double>>").select(
        real_id().alias("doc_id"), "score", "hits")
