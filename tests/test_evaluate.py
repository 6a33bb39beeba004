"""H1-H17 with the published confusion matrices as golden input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimtrail.operators import evaluate

LABELS = ["F_Normal", "F_Crushed", "F_Breakage", "R_Normal", "R_Crushed", "R_Breakage"]
# The two published confusion matrices (rows = truth, columns = prediction).
BASE = [[97, 0, 3, 0, 0, 0], [27, 6, 47, 0, 0, 0], [9, 4, 87, 0, 0, 0],
        [1, 1, 0, 57, 0, 1], [0, 0, 0, 31, 1, 28], [0, 0, 2, 9, 6, 43]]
TUNED = [[94, 6, 0, 0, 0, 0], [17, 56, 7, 0, 0, 0], [4, 17, 79, 0, 0, 0],
         [1, 1, 0, 54, 4, 0], [0, 0, 0, 21, 32, 7], [0, 0, 0, 3, 16, 41]]


def expand(spark, matrix, seed=0):
    rnd = random.Random(seed)
    rows, k = [], 0
    for i, row in enumerate(matrix):
        for j, n in enumerate(row):
            for _ in range(n):
                rows.append((f"img{k:04d}", LABELS[i], LABELS[j], round(rnd.random(), 3), i == j, True))
                k += 1
    return spark.createDataFrame(rows, "key string, label string, pred string, confidence double, "
                                       "correct boolean, free_top_is_letter boolean")


def test_published_accuracy_and_f1(spark):
    b, t = expand(spark, BASE), expand(spark, TUNED)
    assert round(evaluate.accuracy(b).first().accuracy, 4) == 0.6326
    assert round(evaluate.accuracy(t).first().accuracy, 4) == 0.7739
    fb = evaluate.macro_f1(evaluate.per_class(b, LABELS))
    ft = evaluate.macro_f1(evaluate.per_class(t, LABELS))
    assert round(fb.first().macro_f1, 4) == 0.5161 and round(ft.first().macro_f1, 4) == 0.7555
    acc = evaluate.acceptance(fb, ft).first()
    assert round(acc.delta_points, 2) == 23.94 and acc.verdict == "PASS"
    pc = {r.label: r for r in evaluate.per_class(b, LABELS).collect()}
    assert round(pc["F_Crushed"].recall, 3) == 0.075 and pc["F_Normal"].support == 100
    conf = {(r.label, r.pred): r.n for r in evaluate.confusion(b, LABELS).collect()}
    assert conf[("R_Crushed", "R_Normal")] == 31 and conf[("F_Normal", "R_Breakage")] == 0 and len(conf) == 36


def test_selective_accuracy_k_and_partitioning(spark):
    t = expand(spark, TUNED, seed=4)
    s1 = evaluate.selective_accuracy(t, 0.9).first()
    assert s1.k == 414 and s1.n == 460
    pdf = t.toPandas().sort_values(["confidence", "key"], ascending=[False, True])
    want = pdf["correct"].head(414).mean()
    assert s1.selective_accuracy == pytest.approx(want)
    s2 = evaluate.selective_accuracy(t.repartition(7), 0.9).first()   # metamorphic: layout does not matter
    assert (s2.selective_accuracy, s2.abstained_accuracy) == (s1.selective_accuracy, s1.abstained_accuracy)


def test_risk_coverage_ece_brier(spark):
    t = expand(spark, BASE, seed=2)
    pdf = t.toPandas().sort_values(["confidence", "key"], ascending=[False, True]).reset_index(drop=True)
    n = len(pdf)
    rows = {r.coverage: r for r in evaluate.risk_coverage(t).collect()}
    for c in evaluate.COVERAGES:
        k = max(1, int(round(c * n)))
        assert rows[c].kept == k
        assert rows[c].threshold == pdf["confidence"][k - 1]
        assert rows[c].selective_accuracy == pytest.approx(pdf["correct"][:k].mean())
        if k < n:
            assert rows[c].abstained_accuracy == pytest.approx(pdf["correct"][k:].mean())
        else:
            assert rows[c].abstained_accuracy is None
    bins = np.minimum(9, (pdf["confidence"] * 10).astype(int))
    want = sum(len(g) / n * abs(g["correct"].mean() - g["confidence"].mean()) for _, g in pdf.groupby(bins))
    assert evaluate.ece(t).first().ece == pytest.approx(want)
    assert evaluate.brier(t).first().brier == pytest.approx(((pdf["confidence"] - pdf["correct"]) ** 2).mean())


def test_running_accuracy(spark):
    t = expand(spark, TUNED, seed=9)
    got = [(r.row, r.running_accuracy) for r in evaluate.running_accuracy(t, [F.col("key")]).orderBy("row").collect()]
    pdf = t.toPandas().sort_values("key").reset_index(drop=True)
    cum = pdf["correct"].cumsum() / (pdf.index + 1)
    want = [(i + 1, cum[i]) for i in range(len(pdf)) if (i + 1) % 25 == 0 or i + 1 == len(pdf)]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(math.isclose(a[1], b[1]) for a, b in zip(got, want))


def test_stratified_split_sizes(spark):
    rows = [(f"c{c}", f"id{c}-{i}") for c, n in enumerate([90, 10, 7, 1]) for i in range(n)]
    df = spark.createDataFrame(rows, "label string, key string")
    out = evaluate.stratified_split(df, "label", "key")
    counts = {(r.label, r.split): r.n for r in evaluate.split_counts(out).collect()}
    assert counts[("c0", "train")] == int(0.7 * 90) == 62        # float truncation, not 7n // 10
    assert counts[("c0", "val")] == 9 and counts[("c0", "test")] == 19
    assert counts[("c3", "test")] == 1 and counts[("*", "*")] == 108
    again = {(r.key, r.split) for r in evaluate.stratified_split(df.repartition(5), "label", "key").collect()}
    assert again == {(r.key, r.split) for r in out.collect()}


def test_manifest_checks(spark):
    m = spark.createDataFrame([("a", "x", "train", 1, "h1"), ("b", "x", "test", 1, "h2"), ("c", "y", "val", 1, "h1"),
                               ("d", "y", "train", 1, "h1")], "path string, label string, split string, bytes long, sha256 string")
    act = spark.createDataFrame([("a", "h1"), ("b", "zz"), ("e", "h9")], "path string, sha256 string")
    got = {r.path: r.status for r in evaluate.verify_manifest(m, act).collect()}
    assert got == {"a": "ok", "b": "changed", "c": "missing", "d": "missing", "e": "extra"}
    dup = evaluate.duplicate_content(m).first()
    assert dup.sha256 == "h1" and dup.n_paths == 3 and dup.splits == "train,val" and dup.leakage


def test_compare_runs_reports_unmatched(spark):
    a = expand(spark, TUNED, seed=1)
    b = a.where("key <> 'img0000'")
    r = evaluate.compare_runs(a, b).first()
    assert r.identical_predictions and r.max_abs_conf_delta == 0.0 and r.only_a == 1 and r.only_b == 0


def test_train_curve(spark):
    log = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.3), ("r", 3, 0.4)], "run string, step long, loss double")
    r = evaluate.train_curve(log).first()
    assert (r.steps, r.last_loss, r.min_loss) == (3, 0.4, 0.3) and r.mean_loss == pytest.approx(0.4)
