"""Secret scan: fixed patterns, and a token-efficiency test for the rest.

A random string spells badly in a vocabulary that was fitted to language: it
takes many tokens for few characters.  Long runs of token-like characters are
therefore encoded, and a run with fewer than ``max_ratio`` characters for each
token is reported, unless it is a known digest (hex of a digest's length, the
base pattern's matter), an identifier (UUID, number, path of words) or the host of an
address.  Of an address's path each segment is judged by itself.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._common import real_id, slices, texts

# Fixed patterns; the order of KINDS is the order of spans that start together.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{20,}+")                # every long run holds the long hex runs and candidates
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}+")
SEGMENT = re.compile(r"[^/]{20,}+")

DIGEST = re.compile(r"(?:md5|sha1|sha224|sha256|sha384|sha512)?[-_=]?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}"
                    r"|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"     # UUID
                        r"|[0-9+/_=.-]+"                                            # numbers, dates, rules
                        # words of one case, or capitalized, in a path or name; the token ratio judges longer and other letters
                        r"|(?:[A-Z]?[a-z]{1,19}|[A-Z]{1,19})(?:[_/=.-]+(?:[A-Z]?[a-z]{1,19}|[A-Z]{1,19}|[0-9]+))+[/=_.-]*")
# The host and path of a URL, or the host after an @.  What stands before the @ of a URL, its
# query and fragment, and what follows a quote, bracket, comma or the like are no part of it.
ADDRESS = re.compile(r"(?:://(?P<user>[^\s/?#\"'<>{}\[\]()]*@)?|www\.|@(?=[\w-]+\.\w))"
                     r"(?P<host>[\w.~%-]*(?::[0-9]+)?)(?P<path>/[\w.~%+/-]*)?")

MAX_RATIO = 2.1         # random letters of one case stay below it, words of a language above


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the fixed patterns."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found


def random_looking(s: str) -> bool:
    """At least two of lower case, upper case after the first character, digits; or letters of one case, not few ones repeated."""
    return (any(c.islower() for c in s) + any(c.isupper() for c in s[1:]) + any(c.isdigit() for c in s)) >= 2 or (
        s.isalpha() and len(set(s)) >= 8)


def addressed(text: str) -> list[tuple[int, int, int]]:
    """The spans of addresses and where their paths begin, in order."""
    if "://" not in text and "www." not in text and "@" not in text:
        return []
    return [(m.start("host") if m["user"] else m.start(), m.end(), m.start("path") if m["path"] else m.end()) for m in ADDRESS.finditer(text)]


def scan_text(text: str, n_tokens, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int, int]]:
    """(start, index of kind, end, tokens or 0), in order; in time linear in the text, but for sorting what is found."""
    found = base(text)
    runs = list(RUN.finditer(text))
    addresses = addressed(text) if runs else []
    for run in runs:
        found += [(run.start() + m.start(), 2, run.start() + m.end()) for m in HEX.finditer(run[0])]
    found.sort()
    starts, reach = [a for a, _, _ in found], list(accumulate((b for _, _, b in found), max))
    spans = [(*x, 0) for x in found]

    def judge(start: int, end: int) -> None:
        s = text[start:end]
        k = bisect.bisect_right(starts, start) - 1
        if (k >= 0 and reach[k] >= end) or DIGEST.fullmatch(s) or IDENTIFIER.fullmatch(s) or not random_looking(s):
            return
        if len(s) < max_ratio * (n := n_tokens(s)):
            spans.append((start, 3, end, n))

    for run in runs:
        for m in CANDIDATE.finditer(run[0]):
            start, end = run.start() + m.start(), run.start() + m.end()
            k = bisect.bisect_right(addresses, (start, math.inf, math.inf)) - 1
            if k < 0 or end > addresses[k][1]:
                judge(start, end)
            else:       # in an address: nothing of its host, its path segment by segment
                for part in SEGMENT.finditer(text, max(start, addresses[k][2]), end):
                    judge(part.start(), part.end())
    return sorted(spans)


def scan(df: DataFrame, ranks_path: str, pattern: str, max_ratio: float = MAX_RATIO,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end, tokens>>)`` for every row,
    spans in code points by start, then kind; ``end`` is exclusive.

    Null and empty texts give no spans; long texts are scanned whole in one
    pass; rows are independent, so repeated ones and null ids just repeat; an
    empty table gives no rows; extra columns are not carried.
    """
    shared = df.sparkSession.sparkContext.broadcast(bpe.read_ranks(ranks_path))     # fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with bpe.task_encoder(shared, pattern) as encoder:
            n_tokens = lambda s: len(encoder.encode(s))
            for pdf in slices(batches):
                yield pd.DataFrame({
                    "_id": pdf["_id"],
                    "spans": [[{"kind": KINDS[k], "start": a, "end": b, "tokens": n}
                               for a, k, b, n in scan_text(t, n_tokens, max_ratio)] for t in pdf["text"]]})

    found = texts(df, id_col, text_col).mapInPandas(
        run, "_id long, spans array<struct<kind:string,start:int,end:int,tokens:int>>")
    return found.select(real_id().alias("doc_id"), "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
