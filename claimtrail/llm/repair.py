"""Conversation repair as weighted CYK parsing over intervals of rows.

The repaired role initials must be a word of ``(s?(ua)+)?``.  In Chomsky normal
form the repair grammar has a nonterminal <p, q> for each pair of the language's
four states, the rules ``<p, q> -> <p, r> <r, q>``, and as terminals what one row
may become: kept (K), its role set (R) or deleted (D).  Rows of empty text may be
inserted (I) anywhere; their derivations of the empty interval are closed once
(``CLOSURE``) and put around every terminal, so no rule has an empty side.

The cell of an interval holds for each <p, q> the minimum of (cost, audit), the
audit being the edits' initials in order.  The rules hold for every split of an
interval with the same result, so one split is enough, and cells are combined
bottom up by doubling interval lengths: within blocks of ``BLOCK`` rows in a task, then
over the cells of ever longer blocks, so a conversation of any length is parsed by
many tasks.  That minimum and concatenation commute needs that no audit is a
proper prefix of another one of equal cost over the same rows: both have one
letter for each row, so the longer one has further insertions and costs more.

An audit fixes the repaired rows: the role of an edited or inserted row follows
from the state before it, which has one continuation besides the ``s`` of the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rank import global_rank
from ..session import checkpoint_root
from ._common import bounded_batches, key_id, real_id

# fixed values of the edit model
REROLE, DELETE, INSERT, UNDELETED_TRUNCATED = 1, 2, 5, 5
KEEP_LETTER, REROLE_LETTER, DELETE_LETTER, INSERT_LETTER = "K", "R", "D", "I"
START, SYSTEM, USER, ASSISTANT = range(4)           # states: nothing yet, after s, after u, after ua
ACCEPTING = (START, ASSISTANT)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE_NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

BLOCK = 1024            # rows of a block, and cells that one task combines at a time

Cell = dict             # (p, q) -> (cost, audit)


# -- the chart ---------------------------------------------------------------
def combined(a: Cell, b: Cell) -> Cell:
    out: Cell = {}
    for (p, r), (cost, audit) in a.items():
        for (s, q), (more, rest) in b.items():
            if r == s:
                new = (cost + more, audit + rest)
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


def _closure() -> Cell:
    """The empty interval: any number of insertions.  More than one for each state never is cheapest."""
    cell = {(p, p): (0, "") for p in range(4)}
    once = {(p, q): (INSERT, INSERT_LETTER) for (p, x), q in STEPS.items() if x in ROLE_NAMES}
    for _ in range(4):
        longer = combined(cell, once)
        cell = {k: min(c[k] for c in (cell, longer) if k in c) for k in {**cell, **longer}}
    return cell


CLOSURE = _closure()


def terminal(initial: str, fault: str) -> Cell:
    """One row: ``fault`` is b(lank), d(uplicate), t(runcated) or a point."""
    cell = {(p, p): (DELETE, DELETE_LETTER) for p in range(4)}
    if fault not in "bd":
        extra = UNDELETED_TRUNCATED if fault == "t" else 0
        for (p, x), q in STEPS.items():
            if x in ROLE_NAMES:
                cell[p, q] = (REROLE + extra, REROLE_LETTER)
        for (p, x), q in STEPS.items():
            if x == initial:
                cell[p, q] = (extra, KEEP_LETTER)
    return combined(combined(CLOSURE, cell), CLOSURE)


TERMINALS = {(i, f): terminal(i, f) for i in "sua." for f in "bdt."}


def merged(cells: list[Cell]) -> Cell:
    """The cell of neighbouring intervals, by doubling lengths."""
    while len(cells) > 1:
        cells = [combined(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def flat(cell: Cell) -> tuple[list, list]:
    return ([cell[p, q][0] if (p, q) in cell else None for p in range(4) for q in range(4)],
            [cell[p, q][1] if (p, q) in cell else None for p in range(4) for q in range(4)])


def unflat(costs, audits) -> Cell:
    return {(i // 4, i % 4): (int(costs[i]), audits[i]) for i in range(16) if audits[i] is not None}


# -- rows, faults and counts -----------------------------------------------------
def _named(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(key_id(F.col(conv).cast("long")).alias("_conv"), F.col(turn).cast("long").alias("turn"),
                     blank(role).alias("role"), blank(text).alias("text"))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text)`` after damage fixed by crc32(``conv_id:turn``) % 20 (nulls as one
    space there, and as role and text): 0 drops the row, 1 empties its text, 2 removes its ``.!?``,
    3 repeats it, 4 sets the role user.  Rows of equal (conv_id, turn) are damaged alike."""
    rows = _named(df, conv, turn, role, text)
    spelt = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit(" ")) for c in (real_id("_conv"), F.col("turn"))))
    rows = rows.withColumn("_kind", (F.crc32(spelt.cast("binary")) % 20).cast("int")).where(F.col("_kind") != 0)
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        real_id("_conv").alias("conv_id"), "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("_copy")).drop("_copy")


def ordered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with ``_rank``, their place in the order of (conversation, turn, role, text),
    nulls first; equal rows lie side by side, and ranges may cut between them."""
    rows = _named(df, conv, turn, role, text)
    return global_rank(rows, ["_conv", F.col("turn").asc_nulls_first(), "role", "text", F.monotonically_increasing_id()], "_rank").df


def symbols(rows: DataFrame) -> DataFrame:
    """``(_conv, _rank, turn, initial, fault)`` of ``ordered`` rows.  The first of equal (role, text) is found
    by an aggregate and met again on its rank, which no two rows share."""
    stripped = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    initial = F.substring("role", 1, 1)
    narrow = rows.select("_conv", "_rank", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit(".")).alias("initial"),
                         (stripped == "").alias("_blank"), (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("_truncated"),
                         F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("_digest"))
    first = narrow.groupBy("_conv", "_digest").agg(F.min("_rank").alias("_rank")).select("_rank", F.lit(True).alias("_first"))
    fault = (F.when(F.col("_blank"), "b").when(F.col("_first").isNull(), "d").when(F.col("_truncated"), "t").otherwise("."))
    return narrow.join(first, "_rank", "left").select("_conv", "_rank", "turn", "initial", fault.alias("fault"))


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_CELL = ("_conv long, _rank long, blank long, duplicate long, truncated long, illegal long, turns long, "
         "first_turn long, last_turn long, first string, last string, costs array<long>, audits array<string>")


def _leaf(conv: int, rank: int, initials: str, faults: str, turns: list) -> tuple:
    known = [int(t) for t in turns if t is not None]
    costs, audits = flat(merged([TERMINALS[x] for x in zip(initials, faults)]))
    return (conv, rank, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), sum(a != b for a, b in zip([None, *known], known)),
            known[0] if known else None, known[-1] if known else None, initials[0], initials[-1], costs, audits)


def _node(conv: int, cells: list) -> tuple:
    """One cell from those of neighbouring blocks, in order."""
    out = {c: sum(int(x[c]) for x in cells) for c in _COUNTS}
    for a, b in zip(cells, cells[1:]):
        out["illegal"] += a["last"] + b["first"] not in LEGAL
    known = [x for x in cells if x["first_turn"] is not None and not pd.isna(x["first_turn"])]
    for a, b in zip(known, known[1:]):
        out["turns"] -= a["last_turn"] == b["first_turn"]       # one turn on both sides of the border
    costs, audits = flat(merged([unflat(x["costs"], x["audits"]) for x in cells]))
    return (conv, int(cells[0]["_rank"]), *out.values(), int(known[0]["first_turn"]) if known else None,
            int(known[-1]["last_turn"]) if known else None, cells[0]["first"], cells[-1]["last"], costs, audits)


_COLUMNS = [c.split()[0] for c in _CELL.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"first_turn": "Int64", "last_turn": "Int64"})


def cells(signs: DataFrame) -> DataFrame:
    """One cell for each conversation of ``symbols``."""
    spark = signs.sparkSession
    bounded_batches(spark)
    most = signs.groupBy("_conv").count().agg(F.max("count")).first()[0] or 0
    block = F.floor(F.col("_rank") / BLOCK)
    run = F.array_sort(F.collect_list(F.struct("_rank", "initial", "fault", "turn")))       # BLOCK rows at most
    blocks = signs.groupBy("_conv", block.alias("_block")).agg(run.alias("_run")).select(
        "_conv", F.col("_run")[0]["_rank"].alias("_rank"), F.array_join("_run.initial", "").alias("initials"),
        F.array_join("_run.fault", "").alias("faults"), F.col("_run.turn").alias("turns"))

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _frame([_leaf(c, r, i, f, [None if pd.isna(t) else t for t in ts])
                          for c, r, i, f, ts in zip(pdf["_conv"].tolist(), pdf["_rank"].tolist(), pdf["initials"], pdf["faults"], pdf["turns"])])

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _frame([_node(c, list(x)) for c, x in zip(pdf["_conv"].tolist(), pdf["cells"])])

    def joined(df: DataFrame, *block: Column) -> DataFrame:
        several = F.array_sort(F.collect_list(F.struct(*_COLUMNS[1:])))         # of neighbouring blocks: BLOCK cells and one, at most
        return df.groupBy("_conv", *block).agg(several.alias("cells")).select("_conv", "cells").mapInPandas(nodes, _CELL)

    out, width = blocks.mapInPandas(leaves, _CELL), BLOCK
    while most > width:         # doubling goes on over longer blocks, up to one that spans every conversation
        width *= BLOCK
        out = joined(out, F.floor(F.col("_rank") / width).alias("_block"))
    return joined(out)          # one cell, or two on both sides of a border


def parse(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation (see ``repair``)."""
    return _parsed(ordered(df, conv, turn, role, text)).withColumn("conv_id", real_id("_conv")).select("conv_id", *_RESULT)


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _parsed(rows: DataFrame) -> DataFrame:
    ends = F.array(*(F.struct(F.col("costs")[q].alias("cost"), F.col("audits")[q].alias("audit")) for q in ACCEPTING))
    best = F.array_min(F.filter(ends, lambda x: x["audit"].isNotNull()))       # from the start state: the row of START
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(F.lit(0))
    return (cells(symbols(rows)).withColumn("_best", best)
            .select("_conv", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "_best.cost", "_best.audit"))


# -- repaired rows ---------------------------------------------------------------
class _Tape:
    """Follows one conversation's audit over its rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.place = audit, 0, START, 0

    def _put(self, role: str, text: str, letter: str) -> tuple:
        self.state = STEPS[self.state, role[:1]]
        self.at += 1
        self.place += 1
        return self.place, role, text, letter

    def _wanted(self) -> str:
        return ROLE_NAMES["a" if self.state == USER else "u"]

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at:self.at + 1] == INSERT_LETTER:
            yield self._put(self._wanted(), "", INSERT_LETTER)

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        letter = self.audit[self.at]
        if letter == DELETE_LETTER:
            self.at += 1
        else:
            yield self._put(role if letter == KEEP_LETTER else self._wanted(), text, letter)


def _dealt(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows of a conversation behind its audit, in order, ready to stream through one task."""
    heads = parsed.select("_conv", F.lit(-1).cast("long").alias("_rank"), F.lit("").alias("role"), F.col("audit").alias("text"), F.struct(*_RESULT[:-1]).alias("_head"))
    body = rows.select("_conv", "_rank", "role", "text", F.lit(None).cast(heads.schema["_head"].dataType).alias("_head"))
    return heads.unionByName(body).repartition("_conv").sortWithinPartitions("_conv", "_rank")


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations, ``(conv_id, position, role, text, edit)``: position counts from 1, edit is K, R or I."""
    rows = ordered(df, conv, turn, role, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tape = current = None
        for pdf in batches:
            out = []
            for c, rank, role, text in zip(pdf["_conv"].tolist(), pdf["_rank"].tolist(), pdf["role"], pdf["text"]):
                if rank < 0:
                    if tape:
                        out += [(current, *x) for x in tape.inserted()]
                    tape, current = _Tape(text), c
                else:
                    out += [(c, *x) for x in tape.row(role, text)]
            yield pd.DataFrame(out, columns=["_conv", "position", "role", "text", "edit"])
        if tape:
            yield pd.DataFrame([(current, *x) for x in tape.inserted()], columns=["_conv", "position", "role", "text", "edit"])

    dealt = _dealt(rows, _parsed(rows)).drop("_head")
    return dealt.mapInPandas(run, "_conv long, position long, role string, text string, edit string").select(
        real_id("_conv").alias("conv_id"), "position", "role", "text", "edit")


def repair(df: DataFrame, originals: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row for each
    conversation of ``originals`` (default: of ``df``); those without rows have zeros, no audit and the empty string's digest.

    Rows are taken by turn (nulls first), those of equal turn by role and text; a null role or
    text is one space, a null conversation id is a conversation of its own.  Roles count by their
    first letter; an empty role is no legal one.  Repeated rows are rows like others (faults of kind
    duplicate).  An empty table gives no rows; extra columns are not read.  Costs and audits are whole for every
    length.  The digest is that of one string, so a conversation's rows pass, a batch at a time, through one task.
    """
    checkpoint_root(df.sparkSession)
    rows = ordered(df, conv, turn, role, text)
    parsed = _parsed(rows)
    if originals is not None:
        every = originals.select(key_id(F.col(conv).cast("long")).alias("_conv")).distinct()
        parsed = every.join(parsed, "_conv", "left").select(
            "_conv", *(F.coalesce(c, F.lit("" if c == "audit" else 0)).alias(c) for c in _RESULT))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tape = head = None

        def closed() -> tuple:
            feed(tape.inserted())
            return (*head, tape.audit, digest.hexdigest())

        def feed(found: Iterator[tuple]) -> None:
            for place, role, text, _ in found:
                digest.update((b"\n" if place > 1 else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))

        for pdf in batches:
            out = []
            for c, rank, role, text, counts in zip(pdf["_conv"].tolist(), pdf["_rank"].tolist(), pdf["role"], pdf["text"], pdf["_counts"]):
                if rank < 0:
                    if tape:
                        out.append(closed())
                    tape, head, digest = _Tape(text), (c, *(int(x) for x in counts)), hashlib.sha256()
                else:
                    feed(tape.row(role, text))
            yield pd.DataFrame(out, columns=names)
        if tape:
            yield pd.DataFrame([closed()], columns=names)

    names = ["_conv", *_RESULT, "repaired_sha256"]
    dealt = _dealt(rows, parsed)
    dealt = dealt.select("_conv", "_rank", "role", "text", F.array(*(F.col("_head")[c] for c in _RESULT[:-1])).alias("_counts"))
    found = dealt.mapInPandas(run, "_conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                                   "audit string, repaired_sha256 string")
    return found.select(real_id("_conv").alias("conv_id"), *names[1:])
