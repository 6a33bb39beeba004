"""BPE over a distinct-word table: words are split in Spark, every distinct word is
encoded once, and its ids go back to the places where it stands.

1. Tasks split texts into words (the pre-tokenizer's pattern) in slices of bounded
   size.  A text becomes the list of its words' slots in the slice, packed; the slice's
   distinct words leave as packets, one for each part of the distinct-word table.
   A frequent word so is one entry for each slice, however often it stands there.
2. The table is dealt by word.  A task that holds a part encodes each of its words
   once and sends the ids back under (slice, slot).
3. Texts and ids meet again by slice, where the texts' slots lie already; slots give
   every text its ids in order.

Decoding joins ids with the vocabulary's pieces, which is as large as the
vocabulary and not as the corpus.  Added tokens (``<|endoftext|>``) are cut out
of the text first, as the library does, and stand as a word of their own.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import key_id, partitions, real_id, texts
from .bpe import _NOT_LATIN, latin

SLICE_CHARS = 8 << 20       # text of one slice; a longer text is a slice of its own
PARTS = 4                   # parts of the distinct-word table for each shuffle partition
REMEMBERED = 32 << 20       # bytes of words and ids that a part's task remembers

_SLICE = "slice long, part int, words binary, ids binary, lengths binary, slots binary, places binary"


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


# -- packed lists -------------------------------------------------------------
def planed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, their lowest bytes first, then the next: small numbers leave long runs of zeros."""
    return zlib.compress(np.ascontiguousarray(np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 6)


def unplaned(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def packed(items: list[bytes]) -> bytes:
    lengths = planed(np.array([len(x) for x in items], np.uint32))
    return len(lengths).to_bytes(8, "little") + lengths + zlib.compress(b"".join(items), 6)


def unpacked(blob: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(blob[:8], "little")
    raw, ends = zlib.decompress(blob[at:]), np.cumsum(unplaned(blob[8:at]), dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


# -- splitting ----------------------------------------------------------------
class Splitter:
    """Words of a text: added tokens, then the matches of the pattern in between."""

    def __init__(self, pattern: str, added: list[str]):
        self.all_words = regex.compile(pattern).findall
        self.latin_words = re.compile(latin(pattern)).findall
        self.added = re.compile("(" + "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True)) + ")") if added else None

    def plain(self, text: str) -> list[str]:
        return (self.all_words if _NOT_LATIN.search(text) else self.latin_words)(text)

    def __call__(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        out = []
        for i, part in enumerate(self.added.split(text)):
            out += [part] if i % 2 else self.plain(part)
        return out


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        self[word] = slot = len(self)
        return slot


def _slice_rows(number: int, ids: list[int], found: list[list[int]], table: dict[str, int], parts: int) -> pd.DataFrame:
    """Rows of one finished slice: its texts in one, and a packet of words for each part.  Slots are numbered
    anew from the most frequent word on, so that most are small."""
    words = [w.encode("utf-8", "surrogatepass") for w in table]
    flat = np.array(list(chain.from_iterable(found)), np.int64)
    slot = np.empty(len(words), np.uint32)
    slot[np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")] = np.arange(len(words), dtype=np.uint32)
    part = np.array([zlib.crc32(w) for w in words], np.uint32) % np.uint32(parts)
    order = np.array(sorted(range(len(words)), key=lambda i: (part[i], words[i])), np.int64)
    rows = [(number, None, None, np.array(ids, np.int64).tobytes(), np.array([len(x) for x in found], np.int64).tobytes(),
             planed(slot[flat]), planed(slot[order]))]
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        rows.append((number, int(part[at[0]]), packed([words[i] for i in at.tolist()]), None, None, None, None))
    return pd.DataFrame(rows, columns=["slice", "part", "words", "ids", "lengths", "slots", "places"]).astype({"part": "Int32"})


def _cut(df: DataFrame, pattern: str, added: list[str], parts: int, slice_chars: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, first = Splitter(pattern, added), (TaskContext.get().partitionId()) << 32
        number, size, ids, found, table = first, 0, [], [], _Slots()
        for pdf in batches:
            for i, t in zip(pdf["_id"].tolist(), pdf["text"]):
                if size and size + len(t) > slice_chars:
                    yield _slice_rows(number, ids, found, table, parts)
                    number, size, ids, found, table = number + 1, 0, [], [], _Slots()
                ids.append(i)
                found.append(list(map(table.__getitem__, split(t))))
                size += len(t)
        if ids:
            yield _slice_rows(number, ids, found, table, parts)

    return df.mapInPandas(run, _SLICE)


# -- the distinct-word table ----------------------------------------------------
def _encoded(packets: DataFrame, definition: str, n: int) -> DataFrame:
    """Each packet with its words' ids in the place of the words: how many a word has, then all of them."""
    spark = packets.sparkSession
    shared = spark.sparkContext.broadcast(definition)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        table: dict[bytes, np.ndarray] = {}
        held = 0
        for pdf in batches:
            counts, out = [], []
            for blob in pdf["words"]:
                words = unpacked(blob)
                new = [w for w in words if w not in table]
                for w, e in zip(new, tokenizer.encode_batch([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False)):
                    table[w] = np.array(e.ids, "<u4")
                    held += len(w) + 4 * len(e.ids) + 250
                ids = [table[w] for w in words]
                counts.append(planed(np.array([len(x) for x in ids], np.uint32)))
                out.append(planed(np.concatenate(ids)))
                if held > REMEMBERED:
                    table.clear()
                    held = 0
            yield pdf[["slice", "part"]].assign(counts=counts, coded=out)

    return packets.repartition(n, "part").mapInPandas(run, "slice long, part int, counts binary, coded binary")


def definition(path: str) -> tuple[str, dict]:
    """The tokenizer file and its parsed form, read on the driver (its size is the vocabulary's)."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return text, json.loads(text)


def pieces(tokenizer: dict) -> pd.Series:
    """The bytes that each id spells."""
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    spelt = {i: t for t, i in tokenizer["model"]["vocab"].items()} | {a["id"]: a["content"] for a in tokenizer["added_tokens"]}
    raw = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for i, t in spelt.items()}
    return pd.Series(raw, name="piece", dtype=object).sort_index()


def spelt(ids: np.ndarray, table: pd.Series) -> np.ndarray:
    """The piece of every id by a join on the id; ids outside the vocabulary spell nothing, as in the library."""
    got = pd.DataFrame({"id": ids}).join(table, on="id")["piece"]
    return got.where(got.notna(), b"").to_numpy()


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``(doc_id, n_tokens long, packed binary, decoded string)`` for every row: ids as
    little-endian unsigned 32-bit integers, and the text that they spell.

    Null and empty texts have no ids and decode to the empty string; repeated rows each
    give their own row; the id may be null; an empty table gives no rows; extra columns
    are not carried.  A text of any length is one row, and beyond ``slice_chars`` a slice alone.
    """
    spark = df.sparkSession
    text, parsed = definition(path)
    shared = spark.sparkContext.broadcast(pieces(parsed))
    n = partitions(spark)
    cut = _cut(texts(df, id_col, text_col), pattern, [a["content"] for a in parsed["added_tokens"]], PARTS * n, slice_chars)
    # one shuffle serves both uses of the slices, so they are cut once and need no table; a condition
    # that may not be moved below it keeps the optimizer from making two different shuffles
    cut = cut.repartition(n, "slice")
    with_a = lambda c: F.when(F.monotonically_increasing_id() >= 0, F.col(c).isNotNull())
    encoded = _encoded(cut.where(with_a("words")), text, n)

    def meet(docs: pd.DataFrame, packets: pd.DataFrame) -> pd.DataFrame:
        text, out, at = docs.iloc[0], [], 0
        packets = packets.sort_values("part")
        none = np.zeros(0, "<u4")
        ids = np.concatenate([none, *map(unplaned, packets["coded"])])
        ends = np.cumsum(np.concatenate([[0], *map(unplaned, packets["counts"])]).astype(np.int64)).tolist()
        each, raw = spelt(ids, shared.value), ids.tobytes()
        table, words = [b""] * (len(ends) - 1), [b""] * (len(ends) - 1)
        for s, a, b in zip(unplaned(text["places"]).tolist(), ends, ends[1:]):
            table[s], words[s] = raw[4 * a:4 * b], b"".join(each[a:b])
        flat = unplaned(text["slots"]).tolist()
        for i, n in zip(np.frombuffer(text["ids"], np.int64).tolist(), np.frombuffer(text["lengths"], np.int64).tolist()):
            own = flat[at:at + n]
            at += n
            coded = b"".join([table[s] for s in own])
            out.append((i, len(coded) // 4, coded, b"".join([words[s] for s in own]).decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["_id", "n_tokens", "packed", "decoded"])

    docs = cut.where(with_a("ids"))
    return (docs.groupBy("slice").cogroup(encoded.groupBy("slice"))
            .applyInPandas(meet, "_id long, n_tokens long, packed binary, decoded string")
            .select(real_id().alias("doc_id"), "n_tokens", "packed", "decoded"))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<long>)`` for every row, with the results of ``round_trip``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_id": pdf["_id"], "ids": [np.frombuffer(x, "<u4").astype(np.int64) for x in pdf["packed"]]})

    found = round_trip(df, path, pattern, id_col, text_col)
    return (found.select(key_id("doc_id").alias("_id"), "packed").mapInPandas(run, "_id long, ids array<long>")
            .select(real_id().alias("doc_id"), "ids"))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded string)`` for every row with a list of ids: the joined pieces, read as
    UTF-8 (broken sequences as U+FFFD).  Null and empty lists, null ids and ids outside the
    vocabulary spell nothing; repeated rows each give their own row; extra columns are not carried."""
    shared = df.sparkSession.sparkContext.broadcast(pieces(definition(path)[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = np.cumsum([0] + [len(x) for x in pdf["ids"]]).tolist()
            each = spelt(np.concatenate([np.zeros(0, np.int64), *pdf["ids"]]), shared.value)
            yield pd.DataFrame({"_id": pdf["_id"], "decoded": [b"".join(each[a:b]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]})

    known = F.filter(F.coalesce(F.col(ids_col).cast("array<long>"), F.array().cast("array<long>")), lambda i: i.isNotNull())
    return (df.select(key_id(F.col(id_col).cast("long")).alias("_id"), known.alias("ids"))
            .mapInPandas(run, "_id long, decoded string").select(real_id().alias("doc_id"), "decoded"))
