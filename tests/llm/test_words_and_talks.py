"""Importance resampling, word-table BPE and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimtrail.llm import queries, repair, resample, wordbpe
from tests.llm import data


# -- importance resampling ----------------------------------------------------
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def _buckets(text, order, buckets):
    w = WORD.findall((text or "").translate(FOLD))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def _resampled(rows, target, percent, min_words, order, buckets, seed):
    found = [(i, *_buckets(t, order, buckets)) for i, t in rows]
    s = Counter(b for _, _, bs in found for b in bs)
    t = Counter(b for x in target for b in _buckets(x, order, buckets)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, bs in found:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], data.key(x[0]), x[2], x[1]))
    drawn = percent * len(fit) // 100
    rest = [x for x in out if x[4] < min_words]
    return Counter((*x[:4], k + 1 if k < drawn else None) for k, x in enumerate(fit)) + Counter((*x[:4], None) for x in rest)


@pytest.mark.parametrize("order,buckets", [(1, 10_000), (3, 50)])
def test_resampling_equals_brute_force(spark, order, buckets):
    target = [(1, "the tion alpha Alpha, ALPHA"), (2, None), (3, "straße, straße — é"), (3, "the tion alpha Alpha, ALPHA")]
    got = resample.resample(data.frame(spark), spark.createDataFrame(target, "item_id long, text string"), order=order, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = _resampled([r[:2] for r in data.rows()], [t for _, t in target], 10, 20, order, buckets, 2024)
    assert Counter(map(tuple, got.collect())) == want and any(x[4] for x in want)


def test_resampling_of_empty_tables(spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(data.empty(spark), nothing).collect() == []
    got = resample.resample(data.frame(spark), nothing).collect()
    assert Counter(map(tuple, got)) == _resampled([r[:2] for r in data.rows()], [], 10, 20, 1, 10_000, 2024)


def test_payloads_compose_to_the_crc_of_the_whole_run():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "Z", "é", "中", "\U0001f600", " ", "-", "\n", "\x85", "\xa0", "9", "_", "\x7f"]) for _ in range(rng.randint(0, 80)))
        found = next(resample.payloads([text]))
        assert len(found) == len(WORD.findall(text.translate(FOLD))), repr(text)
        assert resample.buckets_of(found, 4, 997).tolist() == _buckets(text, 4, 997)[1]
    long, tail = b"x" * 100_003, b"abc" * 1000
    joined = resample.joined_crc(*(np.array([x], t) for x, t in ((zlib.crc32(long), np.uint32), (zlib.crc32(tail), np.uint32), (len(tail), np.int64))))
    assert joined[0] == zlib.crc32(long + tail)


# -- BPE over distinct words ---------------------------------------------------
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.TOKENIZER)


def _round(library, rows):
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))] += 1
    return want


def _awkward(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "\n", "é", "ß", "the", "ing", "tion", "1", "23", "!", "   ", "中", "\U0001f600", "'s", "'LL", "\x1c", "\x85",
             "\xa0", " ", "ſ", "\t", "=", "aaaa", "<|endoftext|>", "<|endof", "text|>", "​", " ", "\x00", "́", "﻿"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_word_table_round_trip_equals_the_library(spark, library):
    rows = _awkward(1, 3000) + [r[:2] for r in data.rows()] + [(7, "ab" * 30_000), (7, "<|endoftext|>"), (None, "x <|endoftext|>y" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("slice", F.lit("clash")).withColumn("words", F.lit(1))
    for chars in (wordbpe.SLICE_CHARS, 300):
        got = wordbpe.round_trip(df, queries.TOKENIZER, queries.PATTERN, slice_chars=chars).collect()
        assert Counter((r.doc_id, r.n_tokens, bytes(r.packed), r.decoded) for r in got) == _round(library, rows)


def test_texts_are_cut_once(spark):
    """Both uses of the slices read one shuffle."""
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = wordbpe.round_trip(df, queries.TOKENIZER, queries.PATTERN)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("ReusedExchange") == 1 and text.count("MapInPandas") == 2


def test_word_table_forgets_and_encodes_again(spark, library, monkeypatch):
    monkeypatch.setattr(wordbpe, "REMEMBERED", 1)
    rows = _awkward(2, 200)
    got = wordbpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), queries.TOKENIZER, queries.PATTERN, slice_chars=100).collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.packed), r.decoded) for r in got) == _round(library, rows)


def test_encode_and_decode_of_a_table(spark, library):
    rows = [r[:2] for r in data.rows()]
    ids = wordbpe.encode(data.frame(spark), queries.TOKENIZER, queries.PATTERN)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == Counter(
        (i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter(map(tuple, wordbpe.decode(ids, queries.TOKENIZER).collect())) == Counter((i, t or "") for i, t in rows)
    rng = random.Random(3)
    odd = [(i, [rng.randrange(50_300) for _ in range(rng.randint(0, 9))]) for i in range(300)]
    got = wordbpe.decode(spark.createDataFrame([*odd, (900, None)], "doc_id long, ids array<int>"), queries.TOKENIZER).collect()
    assert dict(map(tuple, got)) == {i: library.decode(x, skip_special_tokens=False) for i, x in odd} | {900: ""}
    assert wordbpe.encode(data.empty(spark), queries.TOKENIZER, queries.PATTERN).collect() == []


def test_op12_query(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert Counter(map(tuple, queries.op12_word_bpe(spark, sf).collect())) == Counter(
        (i, n, sha(p), sha(d.encode())) for (i, n, p, d) in _round(library, rows).elements())


# -- conversation repair --------------------------------------------------------
def _ends(text):
    return re.findall(r"[^\x20\x09-\x0D]", text)


def _damage(rows):
    out = []
    for c, t, r, x in rows:
        spelt = f"{' ' if c is None else c}:{' ' if t is None else t}"
        r, x, kind = " " if r is None else r, " " if x is None else x, zlib.crc32(spelt.encode()) % 20
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def _faults(talk):
    seen, out = set(), []
    for _, r, x in talk:
        ends = _ends(x)
        out.append("b" if not ends else "d" if (r, x) in seen else "t" if ends[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def _cheapest(talk, faults):
    """Row by row; at every border insertions until nothing gets cheaper."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(6):
            for p, (cost, audit, rows) in list(best.items()):
                for (a, x), q in steps.items():
                    if a == p and x != "s":
                        new = (cost + 5, audit + "I", (*rows, ({"u": "user", "a": "assistant"}[x], "")))
                        best[q] = min(best.get(q, new), new, key=lambda v: v[:2])
        return best

    for (_, r, x), f in zip(talk, faults):
        now, extra = {}, 5 if f == "t" else 0
        for p, (cost, audit, rows) in insert(best).items():
            ways = [(p, 2, "D", ())]
            if f not in ("b", "d"):
                ways += [(q, 1 + extra, "R", ((name, x),)) for y, name in (("u", "user"), ("a", "assistant")) if (q := steps.get((p, y)))]
                if q := steps.get((p, r[:1])):
                    ways.append((q, extra, "K", ((r, x),)))
            for q, more, letter, new in ways:
                new = (cost + more, audit + letter, rows + new)
                now[q] = min(now.get(q, new), new, key=lambda v: v[:2])
        best = now
    return min((v for p, v in insert(best).items() if p in ("", "a")), key=lambda v: v[:2])


def _every_way(talk, faults):
    """All strings of edits, for very short talks."""
    best = None
    for gaps in itertools.product(range(3), repeat=len(talk) + 1):
        for edits in itertools.product(*(["D"] if f in ("b", "d") else ["K", "U", "A", "D"] for f in faults)):
            roles, cost, audit = "", 0, ""
            for k, g in enumerate(gaps):
                roles, cost, audit = roles + "?" * g, cost + 5 * g, audit + "I" * g
                if k < len(talk):
                    e = edits[k]
                    cost += 2 if e == "D" else (0 if e == "K" else 1) + (5 if faults[k] == "t" else 0)
                    roles += "" if e == "D" else (talk[k][1][:1] or "-").replace("?", "-") if e == "K" else e.lower()
                    audit += "R" if e in "UA" else e
            if best and (cost, audit) >= best:
                continue
            n = len(roles)
            word = "ua" * (n // 2) if n % 2 == 0 else "s" + "ua" * (n // 2) if n > 1 else None
            if word is not None and all(a in ("?", b) for a, b in zip(roles, word)) and not (n % 2 and roles[0] != "s"):
                best = (cost, audit)
    return best


def _order(x):
    return (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())


def _repair(original, damaged):
    out = Counter()
    for c in {x[0] for x in original}:
        talk = sorted((x[1:] for x in damaged if x[0] == c), key=_order)
        if not talk:
            out[(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] += 1
            continue
        f, turns = _faults(talk), [t for t, *_ in talk if t is not None]
        cost, audit, rows = _cheapest(talk, f)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        out[(c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit,
             hashlib.sha256("\n".join(f"{r}:{x}" for r, x in rows).encode()).hexdigest())] += 1
    return out


def _talks(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "so", "so ", "", " \t", "\x85", "what?\n", "a.b", "é.", None, "long " * 300 + ".", ". "]
    roles = ["user", "assistant", "user", "assistant", "system", "User", "tool", "", None, "sys", "unknown", "\U0001f600"]
    out = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            out.append((None if c == 7 else c, rng.choice([t, t, t, t + rng.randint(0, 3), None]), rng.choice(roles[:rng.randint(2, 12)]), rng.choice(texts)))
    return out + out[:3] + out[:3]


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    for name in ("_conv", "_rank", "_kind", "_copy", "initial", "fault", "cost", "audit", "count"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize("block", [1024, 2])
def test_repair_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = _talks(1, 150)
    df = _frame(spark, rows)
    damaged = repair.damaged(df)
    assert Counter(map(tuple, damaged.collect())) == Counter(_damage(rows))
    assert Counter(map(tuple, repair.repair(damaged, originals=df).collect())) == _repair(rows, _damage(rows))
    got = {r.conv_id: r for r in repair.parse(df).collect()}
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert len(got) == len({c for c, *_ in rows})
    by = {}
    for r in sorted(repair.repaired(df).collect(), key=lambda r: r.position):
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    for c, r in got.items():
        talk = sorted((x[1:] for x in clean if x[0] == c), key=_order)
        cost, audit, fixed = _cheapest(talk, _faults(talk))
        assert (r.cost, r.audit) == (cost, audit) and by.get(c, []) == list(fixed)


def test_short_talks_against_every_way():
    rng = random.Random(4)
    for _ in range(400):
        talk = [(t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "so", "", f"{t}."])) for t in range(rng.randint(1, 3))]
        faults = _faults(talk)
        assert _cheapest(talk, faults)[:2] == _every_way(talk, faults), talk


def test_cells_combine_alike_for_every_split():
    rng = random.Random(5)
    for _ in range(300):
        leaves = [repair.TERMINALS[rng.choice("sua."), rng.choice("bdt..")] for _ in range(rng.randint(2, 12))]
        want = repair.merged(leaves)
        left = leaves[0]
        for x in leaves[1:]:
            left = repair.combined(left, x)
        k = rng.randrange(1, len(leaves))
        assert want == left == repair.combined(repair.merged(leaves[:k]), repair.merged(leaves[k:]))


def test_a_long_conversation_is_parsed_by_blocks(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "so", f"{t}.", f"{t}!"])) for t in range(5000)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert Counter(map(tuple, repair.repair(df).collect())) == _repair(rows, rows)


def test_repair_of_an_empty_table(spark):
    df = _frame(spark, [(1, 1, "user", "x")]).where("conv_id = 2")
    assert repair.repair(df, originals=df).collect() == repair.parse(df).collect() == repair.repaired(df).collect() == []


def test_op13_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, queries.op13_repair(spark, sf).collect())) == _repair(rows, _damage(rows))
