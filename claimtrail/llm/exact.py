"""Exact de-duplication by Patricia-trie owners.

Every task inserts its texts as full byte strings into a compressed radix trie, in
which texts share the edges of their common beginnings; a terminal node
holds the group's smallest and largest identifier and its number of rows.  So a
group of copies leaves a task as one row, however many copies it has there.
The rows go to the owner of their (length, content hash), which inserts the byte strings
into one trie for all that it owns and so tells apart different texts that share length and hash.
A trie that outgrows its budget spills its heaviest subtree alone: a task sends that subtree's terminals on as
partial groups, which the owner merges; an owner, whose rows come in order of (length, hash),
emits those that no later row can join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import key_id, partitions, real_id, slices, texts

TRIE_BYTES = 24 << 20       # bytes of text that a task's trie holds before it spills


class _Node:
    __slots__ = ("label", "kids", "group")

    def __init__(self, label: bytes, group=None):
        self.label, self.kids, self.group = label, {}, group


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at:at + n]:
        return n
    lo, hi = 0, n               # a[:lo] is common, a[:hi] isn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[at + lo:at + mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Trie:
    """Compressed radix trie from byte strings to ``[smallest, largest, rows]``."""

    def __init__(self):
        self.root, self.size = _Node(b""), 0

    def insert(self, key: bytes, low: int, high: int, rows: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.group is None:
                    node.group = [low, high, rows]
                else:
                    g = node.group
                    g[0], g[1], g[2] = min(g[0], low), max(g[1], high), g[2] + rows
                return
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = _Node(key[at:], [low, high, rows])
                self.size += len(key) - at
                return
            n = _common(kid.label, key, at)
            if n < len(kid.label):          # split the edge
                upper = _Node(kid.label[:n])
                kid.label = kid.label[n:]
                upper.kids[kid.label[0]] = kid
                node.kids[upper.label[0]] = upper
                kid = upper
            node, at = kid, at + n

    @staticmethod
    def terminals(node: _Node, prefix: bytes = b"") -> Iterator[tuple[bytes, list[int]]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.group is not None:
                yield key, node.group
            stack.extend((k, key) for k in node.kids.values())

    def heaviest(self) -> tuple[list[_Node], _Node] | None:
        """The heaviest subtree of at most half the trie's bytes, or else one leaf, and the nodes above it."""
        weight: dict[int, int] = {}
        stack = [(self.root, False)]
        while stack:
            node, done = stack.pop()
            if done:
                weight[id(node)] = len(node.label) + sum(weight[id(k)] for k in node.kids.values())
            else:
                stack.append((node, True))
                stack.extend((k, False) for k in node.kids.values())
        above, node = [], self.root
        while node.kids:
            above.append(node)
            node = max(node.kids.values(), key=lambda k: weight[id(k)])
            if 2 * weight[id(node)] <= weight[id(self.root)]:
                break
        return (above, node) if above else None

    def spill(self) -> Iterator[tuple[bytes, list[int]]]:
        """Takes the heaviest subtree off and returns its terminals."""
        found = self.heaviest()
        if found is None:
            return
        above, node = found
        prefix = b"".join(n.label for n in above)
        out = list(self.terminals(node, prefix))
        del above[-1].kids[node.label[0]]
        stack = [node]
        while stack:
            gone = stack.pop()
            self.size -= len(gone.label)
            stack.extend(gone.kids.values())
        while len(above) > 1 and not above[-1].kids and above[-1].group is None:       # nothing hangs there any more
            empty = above.pop()
            self.size -= len(empty.label)
            del above[-1].kids[empty.label[0]]
        yield from out

    def take(self) -> Iterator[tuple[bytes, list[int]]]:
        """All terminals; the trie is empty afterwards."""
        root, self.root, self.size = self.root, _Node(b""), 0
        yield from self.terminals(root)


_PART = "n_bytes long, hash long, low long, high long, n long, body binary"


def _place(raw: bytes) -> tuple[int, int]:
    return len(raw), int.from_bytes(xxhash.xxh64_digest(raw), "big", signed=True)


def _rows(found: list) -> pd.DataFrame:
    places = [_place(k) for k, _ in found]
    return pd.DataFrame({
        "n_bytes": [n for n, _ in places], "hash": [h for _, h in places],
        "low": [g[0] for _, g in found], "high": [g[1] for _, g in found], "n": [g[2] for _, g in found],
        "body": [k for k, _ in found]})


def _chunks(found: Iterator, size: int = 4 << 20) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n >= size:
            yield _rows(held)
            held, n = [], 0
    if held:
        yield _rows(held)


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = Trie()
    for pdf in slices(batches):
        for i, t in zip(pdf["_id"].tolist(), pdf["text"]):
            trie.insert(t.encode(), i, i, 1)
        while trie.size > TRIE_BYTES:
            yield from _chunks(trie.spill())
    yield from _chunks(trie.take())


def _owner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (n_bytes, hash), in one trie: what belongs to an earlier pair is complete."""
    def merged():
        trie = Trie()
        for pdf in batches:
            for n_bytes, h, low, high, n, body in pdf.itertuples(index=False, name=None):
                trie.insert(body, int(low), int(high), int(n))
                if trie.size > TRIE_BYTES:
                    now, kept = (n_bytes, h), []
                    while trie.size > TRIE_BYTES // 2:
                        for key, g in trie.spill():
                            if len(key) == n_bytes and _place(key) == now:
                                kept.append((key, g))
                            else:
                                yield key, g
                    for key, g in kept:             # later rows may still join these
                        trie.insert(key, *g)
        yield from trie.take()

    held = []
    for key, g in merged():
        held.append((hashlib.sha256(key).digest(), g[0], g[1], g[2]))
        if len(held) >= 4096:
            yield pd.DataFrame(held, columns=["sha", "low", "high", "n"])
            held = []
    if held:
        yield pd.DataFrame(held, columns=["sha", "low", "high", "n"])


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct text: ``(sha binary, low, high, n)`` with its
    SHA-256, smallest and largest id (null ids count as the smallest) and rows."""
    parts = texts(df, id_col, text_col).mapInPandas(_local, _PART)
    owned = (parts.repartition(partitions(df.sparkSession), "n_bytes", "hash")
             .sortWithinPartitions("n_bytes", "hash"))
    return owned.mapInPandas(_owner, "sha binary, low long, high long, n long")


def assign(df: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with its group: ``(doc_id, keep_id, group_size, kept, sha)``.

    ``keep`` says whether the smallest or the largest id stays.  Null texts
    count as empty ones; a null id counts as smaller than all others, and a
    group of null ids only has a null ``keep_id``; of rows that share text and
    kept id exactly one is kept; an empty table gives no rows; extra columns
    are not carried.
    """
    best = "high" if keep == "largest" else "low"
    own = groups(df, id_col, text_col).select("sha", F.col(best).alias("_keep"), F.col("n").alias("group_size"))
    keyed = texts(df, id_col, text_col).select("_id", F.unhex(F.sha2("text", 256)).alias("sha"))
    row = F.row_number().over(Window.partitionBy("sha", "_id").orderBy("_id"))
    one = keyed.withColumn("_copy", row)
    return one.join(own, "sha").select(
        real_id().alias("doc_id"), real_id("_keep").alias("keep_id"), "group_size",
        ((F.col("_id") == F.col("_keep")) & (F.col("_copy") == 1)).alias("kept"), "sha")


def deduplicated(df: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.  Joined on (text's hash, id),
    so that a large group of copies is spread over the tasks."""
    best = "high" if keep == "largest" else "low"
    own = groups(df, id_col, text_col).select("sha", F.col(best).alias("keep"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(F.struct("*").alias("row"), F.unhex(F.sha2(text, 256)).alias("sha"),
                      key_id(F.col(id_col).cast("long")).alias("keep"))
    return keyed.join(own, ["sha", "keep"], "left_semi").dropDuplicates(["sha", "keep"]).select("row.*")
