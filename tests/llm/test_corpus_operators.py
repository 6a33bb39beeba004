"""De-duplication, mixing, quality and the pipeline against brute force."""

import hashlib
import inspect
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from claimtrail.llm import exact, fmindex, graph, mixing, quality, queries, simhash, suffix
from tests.llm import data


# -- exact ------------------------------------------------------------------
def test_exact_groups(spark):
    got = exact.assign(data.frame(spark)).collect()
    groups = defaultdict(list)
    for i, t, *_ in data.rows():
        groups[t or ""].append(data.key(i))
    want = Counter()
    for i, t, *_ in data.rows():
        want[(i, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.group_size, r.sha.hex()) for r in got) == want
    for r in got:
        t = next(t or "" for t in groups if hashlib.sha256(t.encode()).digest() == bytes(r.sha))
        assert data.key(r.keep_id) == max(groups[t])
    assert sum(r.kept for r in got) == len(groups)
    assert all(data.key(r.doc_id) == data.key(r.keep_id) for r in got if r.kept)
    assert exact.assign(data.empty(spark)).collect() == []


def test_exact_keeps_one_row_with_all_columns(spark):
    df = data.frame(spark)
    kept = exact.deduplicated(df)
    assert kept.columns == df.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t, *_ in data.rows()})


def test_trie_and_spill():
    rng = random.Random(0)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    trie, want = exact.Trie(), {}
    for i, k in enumerate(keys):
        trie.insert(k, i, i, 1)
        w = want.setdefault(k, [i, i, 0])
        w[1], w[2] = i, w[2] + 1
    assert dict(exact.Trie.terminals(trie.root)) == want
    seen, before = {}, trie.size
    while trie.size:                        # one subtree after the other, the rest stays right
        part = dict(trie.spill())
        assert part and not part.keys() & seen.keys() and trie.size < before
        before = trie.size
        seen |= part
        assert dict(exact.Trie.terminals(trie.root)) | seen == want
    assert seen | dict(trie.take()) == want


def test_texts_share_the_edges_of_their_beginning():
    head = b"one long beginning that all of these texts have in common, " * 20
    trie = exact.Trie()
    for i in range(2000):
        trie.insert(head + str(i).encode(), i, i, 1)
    assert len(trie.root.kids) == 1 and next(iter(trie.root.kids.values())).label == head and trie.size < len(head) + 2000 * 4


@pytest.mark.parametrize("budget", [1, 2000, 60_000])
def test_owners_that_spill_find_the_same_groups(spark, monkeypatch, budget):
    """Texts of equal length and equal (forged) hash, copies and common beginnings, under budgets that force spills."""
    monkeypatch.setattr(exact, "TRIE_BYTES", budget)
    rng = random.Random(3)
    rows = [(i, "begin " * rng.randint(0, 30) + rng.choice("abc") * rng.randint(0, 3)) for i in range(400)]
    place = lambda raw: (len(raw), len(raw) % 2)                                  # noqa: E731
    monkeypatch.setattr(exact, "_place", place)
    pdf = lambda rs: __import__("pandas").DataFrame(rs, columns=["_id", "text"])
    parts = [p for p in exact._local(iter([pdf(rows[:200]), pdf(rows[200:])]))]
    found = __import__("pandas").concat(parts).sort_values(["n_bytes", "hash"])
    got = {bytes(r.sha): (r.low, r.high, r.n) for p in exact._owner(iter([found])) for r in p.itertuples()}
    want = defaultdict(list)
    for i, t in rows:
        want[hashlib.sha256(t.encode()).digest()].append(i)
    assert got == {k: (min(v), max(v), len(v)) for k, v in want.items()}


# -- simhash ----------------------------------------------------------------
def _fingerprint(text):
    w = data.words((text or "").encode().lower().decode())
    if not w:
        return 0
    parts = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_bit_sliced_comparison():
    rng = np.random.default_rng(0)
    for radius in (1, 2, 3, 4):
        for n in (1, 2, 63, 64, 65, 200):
            f = rng.choice(rng.integers(0, 1 << 63, size=max(1, n // 6), dtype=np.uint64), n)
            for _ in range(4):
                f = f ^ (np.uint64(1) << rng.integers(0, 64, size=n).astype(np.uint64)) * rng.integers(0, 2, size=n).astype(np.uint64)
            assert (simhash.near(f, radius) == (np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)).all()


def test_tables_meet_all_near_fingerprints_in_bounded_buckets():
    rng = random.Random(1)
    plan = simhash.tables(2)
    assert all(64 - bin(m).count("1") <= 11 for _, inner in plan for m in inner)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        met = [inner for m, inner in plan if x & m == y & m]
        assert met and all(any(x & m == y & m for m in inner) for inner in met)


@pytest.mark.parametrize("bucket", [2048, 3])
def test_links_connect_what_the_radius_connects(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)      # the driver's plan: buckets beyond it are keyed again
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for f in list(fps)[:10]:
        for _ in range(12):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_simhash_components(spark):
    got = simhash.assign(data.frame(spark)).collect()
    fps = [(i, _fingerprint(t)) for i, t, *_ in data.rows()]
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter(fps)
    group = {f: f for _, f in fps}
    changed = True
    while changed:
        changed = False
        for a in group:
            low = min(group[b] for b in group if bin(a ^ b).count("1") <= 2)
            changed |= low < group[a]
            group[a] = min(group[a], low)
    lowest = defaultdict(list)
    for i, f in fps:
        lowest[group[f]].append(i)
    for r in got:
        ids = [i for i in lowest[group[r.fp & (1 << 64) - 1]] if i is not None]
        assert r.component_id == min(ids, default=None)
    df = data.frame(spark)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == len(set(group.values()))
    assert simhash.assign(data.empty(spark)).collect() == []


# -- repeated substrings ----------------------------------------------------
def _texts(seed, n=90):
    rng = random.Random(seed)
    letters = ["ab", "c", "de", "fgh", "é", "xyz"]
    base = [[rng.choice(letters) for _ in range(rng.randint(0, 60))] for _ in range(10)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(base)[rng.randint(0, 10):][:rng.randint(3, 60)] + [rng.choice(letters) for _ in range(rng.randint(0, 2))]
        rows.append((i * 7 % n * 10, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(9991, "a" * 300), (9992, "a " * 150 + "b"), (9993, "a " * 200), (9994, ""), (9995, None), (None, rows[3][1])]
    return rows + [(10000 + i, rows[5][1]) for i in range(10)] + [rows[7]]


def _bytes_left(rows, length):
    first = {}
    keyed = [(data.key(i), (t or "").encode()) for i, t in rows]
    for i, b in keyed:
        for p in range(len(b) - length + 1):
            first[b[p:p + length]] = min(first.get(b[p:p + length], (i, p)), (i, p))
    out = Counter()
    for i, b in keyed:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < (i, p):
                gone[p:p + length] = b"\1" * length
        out[(i, bytes(x for x, g in zip(b, gone) if not g))] += 1
    return out


def _words_left(rows, window):
    first = {}
    keyed = [(data.key(i), data.words(t)) for i, t in rows]
    for i, w in keyed:
        for p in range(len(w) - window + 1):
            first[tuple(w[p:p + window])] = min(first.get(tuple(w[p:p + window]), i), i)
    out = Counter()
    for i, w in keyed:
        gone = bytearray(len(w))
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone[p:p + window] = b"\1" * window
        out[(i, b" ".join(x for x, g in zip(w, gone) if not g).decode())] += 1
    return out


# the last three settings force buckets by window, pieces of long texts, and buckets sent by segment
SIZES = [dict(), dict(bucket=3, block=40), dict(bucket=3, slice=150, block=40), dict(bucket=40, slice=90, wide=2, block=10)]


@pytest.mark.parametrize("sizes", SIZES)
def test_suffix_dedup(spark, sizes):
    rows = _texts(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("tag", F.lit("clash"))
    got = suffix.removed(df, 20, 7, **sizes).collect()
    assert Counter((data.key(r.doc_id), bytes(r.kept)) for r in got) == _bytes_left(rows, 20)
    for r in got:
        assert r.n_bytes == len(r.kept) + sum(s["end"] - s["start"] for s in r.spans)
        assert all(a["end"] < b["start"] for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("sizes", SIZES)
def test_substring_dedup(spark, sizes):
    rows = _texts(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("tag", F.lit("clash"))
    got = fmindex.removed(df, 6, 3, **sizes).collect()
    assert Counter((data.key(r.doc_id), r.kept) for r in got) == _words_left(rows, 6)


def test_production_lengths_on_the_awkward_table(spark):
    rows = [(i, t) for i, t, *_ in data.rows()]
    df = data.frame(spark)
    assert Counter((data.key(r.doc_id), bytes(r.kept)) for r in suffix.removed(df).collect()) == _bytes_left(rows, 100)
    assert Counter((data.key(r.doc_id), r.kept) for r in fmindex.removed(df).collect()) == _words_left(rows, 13)
    assert suffix.removed(data.empty(spark)).collect() == [] and fmindex.removed(data.empty(spark)).collect() == []


def test_windows_beyond_the_packed_range_are_refused(spark):
    rows = _texts(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for operator in (suffix.removed, fmindex.removed):
        with pytest.raises(ValueError):
            operator(df, 400, 32)
    got = suffix.removed(df, 400, 145).collect()
    assert Counter((data.key(r.doc_id), bytes(r.kept)) for r in got) == _bytes_left(rows, 400)


def test_bucket_pointers_and_wavelet_ranks():
    rng = random.Random(3)
    for length in (3, 8, 13, 20, 33, 100):
        bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randint(length, length + 20))) for _ in range(40)]
        windows = [b[p:p + length] for b in bodies for p in range(len(b) - length + 1)]
        got = suffix.buckets(bodies, length).tolist()
        assert len(set(zip(windows, got))) == len(set(windows)) == len(set(got))
    for sigma in (1, 2, 5, 64, 100):
        s = np.array([rng.randrange(sigma) for _ in range(300)])
        m = fmindex.WaveletMatrix(s, sigma)
        c = np.array([rng.randrange(sigma) for _ in range(200)])
        lo = np.array([rng.randint(0, 300) for _ in range(200)])
        hi = np.array([rng.randint(x, 300) for x in lo])
        a, b = m.rank(c, lo, hi)
        assert a.tolist() == [int((s[:y] == x).sum()) for x, y in zip(c, lo)]
        assert b.tolist() == [int((s[:y] == x).sum()) for x, y in zip(c, hi)]


# -- mixing -----------------------------------------------------------------
def _targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > cap * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 20, 80, 300])), "en", s, 1)
            for i in range(900) for s in [rng.choice(["a", "b", "b", "b", "c", "d", "é", None])]] + data.rows()
    df = spark.createDataFrame(rows, data.SCHEMA).repartition(4).withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(data.words(t))
    want = _targets(sizes)
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], largest[s]), (s, taken[s], want[s])
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    whole = mixing.mixed(df)
    assert whole.columns == df.columns
    assert sum(len(data.words(r.text)) for r in whole.collect()) == sum(taken.values())
    assert mixing.mix(data.empty(spark)).collect() == []


def test_rates_are_tilted_by_size(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), "en", "ab"[i % 2], 1) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, data.SCHEMA), weights=(9, 1), share=1.0).collect()
    rate = defaultdict(list)
    for r in got:
        rate[(r.source, r.size > 20)].append(r.copies)
    mean = {k: sum(v) / len(v) for k, v in rate.items()}
    assert mean[("a", True)] >= mean[("a", False)] and mean[("b", True)] < mean[("b", False)]


# -- quality and the pipeline ------------------------------------------------
def _judged(seed=7, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        w = [rng.choice(["the", "model", "answers", "questions", "about", "weather", "and", "rivers"]) for _ in range(rng.randint(15, 80))]
        text = " ".join(w).capitalize() + "." if good else rng.choice(["###".join(w), " ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 40)])
        rows.append((i, text, rng.choice(["en", None]), rng.choice(["s0", "s1", None]), len(text)))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = _judged()
    df = spark.createDataFrame(rows, data.SCHEMA).withColumn("score", F.lit("clash"))
    model = quality.train(df, spark.createDataFrame(labels[:200], "doc_id long, quality int"))
    got = {r.doc_id: r.q for r in quality.scored(df, model, "q").select("doc_id", "q").collect()}
    right = sum((got[i] >= quality.THRESHOLD) == bool(y) for i, y in labels[200:])
    assert right >= 0.98 * 200
    assert set(quality.accepted(df, model).columns) == set(df.columns)
    # each view alone learns as well
    for view, x in zip(model.views, quality._views(spark.createDataFrame(rows[200:], data.SCHEMA).toPandas())):
        assert np.mean((view.logit(x) > 0) == np.array([y for _, y in labels[200:]])) > 0.9
    awkward = quality.scored(data.frame(spark), model, "q")
    assert awkward.count() == len(data.rows()) and awkward.where("q is null or q < 0 or q > 1").count() == 0
    assert quality.scored(data.empty(spark), model).collect() == []
    none = quality.train(data.empty(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.q for r in quality.scored(df.limit(1), none, "q").collect()] == [1.0]


def _fitted_on(monkeypatch, df, labels):
    """(labelled rows, pool rows) that reach the models."""
    seen = []
    monkeypatch.setattr(quality, "cotrain", lambda known, pool: seen.append((known.count(), pool.count())) or quality.Model(None))
    quality.train(df, labels)
    return seen[0]


def test_quality_fits_on_the_whole_sample_and_labels_every_other_row(spark, monkeypatch):
    df = spark.range(24_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"),
                                    F.lit("s0").alias("source"), F.lit(9).alias("n_chars"))
    labels = spark.range(12_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    known, free = _fitted_on(monkeypatch, df, labels)
    assert 5_700 < known < 6_300 and free == 24_000 - known
    assert inspect.signature(quality.fit).parameters["steps"].default == 300


def test_quality_takes_one_row_of_a_repeated_labelled_id(spark, monkeypatch):
    ids = list(range(20)) + [3] * 300 + [15] * 300 + [None] * 300
    df = spark.createDataFrame([(i, f"text {n}", "en", "s0", 9) for n, i in enumerate(ids)], data.SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    assert _fitted_on(monkeypatch, df, labels) == (10, 10 + 300 + 300)


def test_quality_rounds_exchange_labels(spark, monkeypatch):
    """Each round adds rows that the other view is sure of, with right labels."""
    rows, labels = _judged(9, 1200)
    added, drawn = [], quality._labelled_by_the_other

    def watched(*args):
        added.append(drawn(*args).collect())
        return drawn(*args)

    monkeypatch.setattr(quality, "_labelled_by_the_other", watched)
    truth = {x[0]: y for x, (_, y) in zip(rows, labels)}
    key = {r.key: truth[r.doc_id] for r in spark.createDataFrame(rows, data.SCHEMA).select(
        "doc_id", F.xxhash64("doc_id", "text", "source", "lang", F.col("n_chars").cast("double")).alias("key")).collect()}
    quality.train(spark.createDataFrame(rows, data.SCHEMA), spark.createDataFrame(labels[:200], "doc_id long, quality int"))
    assert len(added) == quality.ROUNDS
    for found in added:
        assert {r.view for r in found} == {0, 1} and {r.y for r in found} == {0, 1}
        assert sum(key[r.key] == r.y for r in found) >= 0.95 * len(found)


def test_margin_limits():
    n = np.zeros(quality._BINS, np.int64)
    n[[0, 10, 1190, 1199]] = [50, 50, 300, 600]
    low, some_low, high, some_high = quality._limits(n, 0.1, 40, 0.75)
    assert (low, high) == (0, 1199) and math.isclose(some_low, 10 / 50) and math.isclose(some_high, 30 / 600)
    n[:] = 0
    n[quality._BINS // 2] = 1000                # nobody is sure
    low, _, high, _ = quality._limits(n, 0.1, 40, 0.5)
    assert n[:low + 1].sum() == 0 and n[high:].sum() == 0


def test_quality_scores_a_very_long_text(spark):
    rows, labels = _judged()
    model = quality.train(spark.createDataFrame(rows, data.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"))
    long = [(1, "The model answers questions about weather. " * 60_000, "en", "s0", 1), (2, "###the###model" * 150_000, "en", "s0", 1)]
    got = {r.doc_id: r.q for r in quality.scored(spark.createDataFrame(long, data.SCHEMA), model, "q").collect()}
    assert got[1] > got[2] and all(0 <= x <= 1 for x in got.values())


def test_pipeline_stages(spark, tmp_path):
    rows, labels = _judged(8, 300)
    rows += [(1000 + i, *rows[1][1:]) for i in range(5)] + [(2000, rows[2][1].upper(), *rows[2][2:])]
    spark.createDataFrame(rows, data.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        docs = corpus_pipeline.stored(docs, "test")
        seen.append(docs.collect())
    raw, good, unique, near, mix = seen
    clean = {i for i, y in labels if y}
    assert len(clean - {r.doc_id for r in good}) <= 0.02 * len(clean)
    want = {}
    for r in good:
        want[r.text] = max(want.get(r.text, -1), r.doc_id)
    assert {r.text: r.doc_id for r in unique} == want and len(unique) == len(want)
    assert {r.doc_id for r in near} <= {r.doc_id for r in unique}
    fps = [_fingerprint(r.text) for r in near]
    assert all(bin(a ^ b).count("1") > 2 for i, a in enumerate(fps) for b in fps[:i])
    assert set(Counter(r.doc_id for r in mix).values()) <= {1, 2}
    last = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in mix)
    assert {r.doc_id: r.decoded_sha256 for r in last} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in mix}
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, run)) == Counter(map(tuple, last))


def test_pipeline_of_empty_and_widened_tables(spark, tmp_path):
    """No rows give no rows; extra columns, also with the operators' own names, change nothing."""
    data.empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    rows, labels = _judged(10, 120)
    rows += [(None, None, None, None, None), (None, rows[1][1], "en", "s0", 1), (500, "", None, "s0", None), rows[5], rows[5]]
    plain = spark.createDataFrame(rows, data.SCHEMA)
    wide = plain.select("*", *(F.lit("clash").alias(c) for c in ("key", "y", "sha", "tag", "size", "ids", "_id", "score", "fp")))
    out = []
    for name, df in (("plain", plain), ("wide", wide)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out.append(Counter(map(tuple, corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect())))
    assert out[0] == out[1] and out[0]


@pytest.mark.parametrize("name", ["op10_exact_dedup", "op11_resample", "op13_repair"])
def test_queries_equal_their_sql(spark, name):
    from tests.oracle_compare import compare
    r = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.001")
    assert r["status"] == "ok", r


def test_queries_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)
