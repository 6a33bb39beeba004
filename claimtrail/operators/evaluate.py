"""Classifier evaluation, calibration, splits and manifests.

Predictions table: ``(key, label, pred, confidence double, correct boolean,
free_top_is_letter boolean)``.  Orders over all rows (selective accuracy,
risk-coverage, running accuracy, percentiles) use ``functions.rank``: no
single-partition window.  Numbers derived from the row count (k, thresholds)
are computed on the driver from that one count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import global_rank, global_running_sum, rank_within

# The coverage levels of the risk-coverage table.
COVERAGES = (1.0, 0.95, 0.9, 0.8, 0.7, 0.5)
ACCEPTANCE_POINTS = 10.0


def _round_half_even(x: float) -> int:
    return int(round(x))


# ---------------------------------------------------------------- H1
def golden_eval(assessed: DataFrame, golden: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """H1: cases, risk_accuracy, citation_validity (share with at least one
    citation, as the reference counts it); 0.0 when there are no golden rows.
    A golden case without an assessment (rejected input) counts as wrong and
    uncited.  With ``sources``, ``grounded_validity`` re-checks the citations
    (share of cases whose citations all resolve, E5)."""
    a = assessed.select("case_id", "risk", "citations")
    if sources is not None:
        from .validate import explode_citations, ground_citations
        bad = ground_citations(explode_citations(a), sources).where(F.col("status") != "ok") \
            .select("case_id").distinct().withColumn("_bad", F.lit(True))
        a = a.join(bad, "case_id", "left")
    j = golden.join(a, "case_id", "left")
    cited = F.coalesce(F.size("citations"), F.lit(0)) > 0
    aggs = [
        F.count(F.lit(1)).alias("cases"),
        F.coalesce(F.avg(F.coalesce(F.col("risk") == F.col("expected_risk"), F.lit(False)).cast("double")),
                   F.lit(0.0)).alias("risk_accuracy"),
        F.coalesce(F.avg(cited.cast("double")), F.lit(0.0)).alias("citation_validity"),
    ]
    if sources is not None:
        aggs.append(F.coalesce(F.avg((cited & F.col("_bad").isNull()).cast("double")), F.lit(0.0))
                    .alias("grounded_validity"))
    return j.agg(*aggs)


# ---------------------------------------------------------------- H2-H5
def accuracy(preds: DataFrame) -> DataFrame:
    """H2: n, accuracy, mean confidence, rate of unrestricted answers that
    are class tokens."""
    return preds.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("free_top_is_letter").cast("double")).alias("letter_rate"),
    )


def confusion(preds: DataFrame, labels: Sequence[str]) -> DataFrame:
    """H3: dense (label, pred, n) over the fixed label list, zeros kept; a
    pair outside the list is counted under pred ``"(other)"`` instead of
    failing."""
    counts = preds.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    lab = F.array(*[F.lit(x) for x in labels])
    grid = (preds.sparkSession.range(1)
            .select(F.explode(lab).alias("label"))
            .select("label", F.explode(lab).alias("pred")))
    dense = grid.join(counts, ["label", "pred"], "left").select(
        "label", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    listed = lambda c: F.coalesce(F.col(c).isin(*labels), F.lit(False))  # noqa: E731  null: not listed
    other = counts.where(~listed("label") | ~listed("pred")).select(
        "label", F.lit("(other)").alias("pred"), F.col("n").cast("bigint"))
    return dense.unionByName(other.groupBy("label", "pred").agg(F.sum("n").cast("bigint").alias("n")))


def per_class(preds: DataFrame, labels: Sequence[str]) -> DataFrame:
    """H4: precision, recall, F1, support per class; 0 on empty denominators.
    A null prediction (unparsed) is a wrong one."""
    def of(col: str, c: str):
        return F.col(col).eqNullSafe(F.lit(c))
    agg = preds.agg(*[
        F.struct(
            F.sum((of("pred", c) & of("label", c)).cast("long")).alias("tp"),
            F.sum((of("pred", c) & ~of("label", c)).cast("long")).alias("fp"),
            F.sum((~of("pred", c) & of("label", c)).cast("long")).alias("fn"),
        ).alias(f"c{i}") for i, c in enumerate(labels)])
    rows = agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("cls"), F.col(f"c{i}.tp").alias("tp"), F.col(f"c{i}.fp").alias("fp"),
                 F.col(f"c{i}.fn").alias("fn")) for i, c in enumerate(labels)])))
    tp, fp, fn = (F.coalesce(F.col(x), F.lit(0)).cast("double") for x in ("tp", "fp", "fn"))
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return rows.select(F.col("cls").alias("label"), p.alias("precision"), r.alias("recall"), f1.alias("f1"),
                       (tp + fn).cast("bigint").alias("support"))


def macro_f1(per_class_df: DataFrame) -> DataFrame:
    """H5: plain mean of F1 over the label list."""
    return per_class_df.agg(F.avg("f1").alias("macro_f1"))


# ---------------------------------------------------------------- H6 / H7
def _conf_order(tie_break: str):
    return [F.col("confidence").desc(), F.col(tie_break).asc()]


def selective_accuracy(preds: DataFrame, coverage: float = 0.9, tie_break: str = "key") -> DataFrame:
    """H6: keep the k = round-half-even(coverage·n) most confident rows (ties
    by ``tie_break``); accuracy on kept and on abstained rows (0.0 when none
    abstained)."""
    ranked = global_rank(preds.select(*{"confidence", "correct", tie_break}), _conf_order(tie_break))
    n = ranked.n
    k = _round_half_even(coverage * n)
    kept = F.col("rank") <= F.lit(k)
    return ranked.df.agg(
        F.lit(n).cast("bigint").alias("n"), F.lit(k).cast("bigint").alias("k"),
        (F.sum(F.when(kept, F.col("correct").cast("double"))) / F.lit(float(max(k, 1)))).alias("selective_accuracy"),
        F.coalesce(F.sum(F.when(~kept, F.col("correct").cast("double"))), F.lit(0.0)).alias("_ab")
    ).select("n", "k", F.coalesce("selective_accuracy", F.lit(0.0)).alias("selective_accuracy"),
             (F.col("_ab") / F.lit(float(max(1, n - k)))).alias("abstained_accuracy"))


def risk_coverage(preds: DataFrame, coverages: Sequence[float] = COVERAGES, tie_break: str = "key") -> DataFrame:
    """H7: per coverage c: kept = max(1, round(c·n)), the confidence threshold
    at the last kept row, accuracy on kept rows and on the rest (null when
    nothing is abstained).  One pass: conditional aggregates per coverage."""
    ranked = global_rank(preds.select(*{"confidence", "correct", tie_break}), _conf_order(tie_break))
    n = ranked.n
    ks = [max(1, _round_half_even(c * n)) for c in coverages]
    aggs = []
    for i, k in enumerate(ks):
        kept = F.col("rank") <= F.lit(k)
        aggs += [
            F.sum(F.when(kept, F.col("correct").cast("double"))).alias(f"s{i}"),
            F.sum(F.when(~kept, F.col("correct").cast("double"))).alias(f"a{i}"),
            F.max(F.when(F.col("rank") == F.lit(k), F.col("confidence"))).alias(f"t{i}"),
        ]
    one = ranked.df.agg(*aggs)
    rows = F.array(*[F.struct(
        F.lit(float(c)).alias("coverage"), F.lit(k).cast("bigint").alias("kept"),
        F.col(f"t{i}").alias("threshold"),
        (F.col(f"s{i}") / F.lit(float(k))).alias("selective_accuracy"),
        (F.col(f"a{i}") / F.lit(float(n - k)) if n - k > 0 else F.lit(None).cast("double")).alias("abstained_accuracy"),
    ) for i, (c, k) in enumerate(zip(coverages, ks))])
    return one.select(F.inline(rows))


# ---------------------------------------------------------------- H8 / H9
def ece(preds: DataFrame, bins: int = 10) -> DataFrame:
    """H8: equal-width bins (top bin closed), Σ n_b/n·|acc_b − conf_b|."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("confidence") * F.lit(float(bins))).cast("int"))
    per_bin = preds.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("nb"), F.avg(F.col("correct").cast("double")).alias("acc"),
        F.avg("confidence").alias("conf"))
    return per_bin.agg((F.sum(F.col("nb") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("nb")).alias("ece"))


def brier(preds: DataFrame) -> DataFrame:
    """H9: mean (confidence − correct)²."""
    return preds.agg(F.avg(F.pow(F.col("confidence") - F.col("correct").cast("double"), 2)).alias("brier"))


# ---------------------------------------------------------------- H10 / H11
def compare_runs(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Equi-join on ``key`` (the reference zips by position and ignores
    surplus rows; here unmatched rows are counted): identical predictions,
    max |confidence delta|, identical content, unmatched on either side."""
    x = a.select(key, F.col("pred").alias("pa"), F.col("confidence").alias("ca"), F.lit(1).alias("ina"))
    y = b.select(key, F.col("pred").alias("pb"), F.col("confidence").alias("cb"), F.lit(1).alias("inb"))
    j = x.join(y, key, "full_outer")
    both = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    return j.agg(
        F.coalesce(F.bool_and(F.when(both, F.col("pa") == F.col("pb"))), F.lit(True)).alias("identical_predictions"),
        F.max(F.when(both, F.abs(F.col("ca") - F.col("cb")))).alias("max_abs_conf_delta"),
        F.coalesce(F.bool_and(both & (F.col("pa") == F.col("pb")) & (F.col("ca") == F.col("cb"))),
                   F.lit(True)).alias("identical_content"),
        F.sum(F.when(F.col("inb").isNull(), 1).otherwise(0)).cast("bigint").alias("only_a"),
        F.sum(F.when(F.col("ina").isNull(), 1).otherwise(0)).cast("bigint").alias("only_b"),
    )


def acceptance(base_f1: DataFrame, tuned_f1: DataFrame, threshold: float = ACCEPTANCE_POINTS) -> DataFrame:
    """Delta macro-F1 in points and PASS when ≥ threshold.  The two
    one-row inputs are tagged, unioned and folded by one aggregate (no
    join)."""
    both = base_f1.select(F.lit("base").alias("_r"), "macro_f1").unionByName(
        tuned_f1.select(F.lit("tuned").alias("_r"), "macro_f1"))
    one = both.agg(F.max(F.when(F.col("_r") == "base", F.col("macro_f1"))).alias("base"),
                   F.max(F.when(F.col("_r") == "tuned", F.col("macro_f1"))).alias("tuned"))
    d = (F.col("tuned") - F.col("base")) * 100.0
    return one.select("base", "tuned", d.alias("delta_points"),
                      F.when(d >= threshold, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("verdict"))


# ---------------------------------------------------------------- H12
def running_accuracy(preds: DataFrame, order_by: Sequence, every: int = 25) -> DataFrame:
    """Cumulative accuracy at every ``every``-th row and at the last
    row, in the given order (no single-partition window)."""
    r = global_running_sum(preds.withColumn("_c", F.col("correct").cast("double")), order_by, "_c",
                           out="_cum")
    n = r.n
    out = r.df.where((F.col("rank") % every == 0) | (F.col("rank") == F.lit(n)))
    return out.select(F.col("rank").alias("row"), (F.col("_cum") / F.col("rank")).alias("running_accuracy"))


# ---------------------------------------------------------------- H13 / H14
def stratified_split(rows: DataFrame, label: str, key: str, seed: int = 42,
                     train: float = 0.7, val: float = 0.1) -> DataFrame:
    """Per class, rows ordered by SHA-256 of ``seed:key`` (a seeded
    shuffle that any engine can repeat); the first floor(train·n) train, the
    next floor(val·n) val, the rest test.  Ranks within each class come from
    one global rank over (label, hash) — a large class is spread over many
    tasks."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    ranked = global_rank(rows.withColumn("_h", h), [F.col(label), F.col("_h"), F.col(key)], "_rk").df
    r = rank_within(ranked, [label], "_rk", "_rn", "_n")
    n_train = F.floor(F.lit(float(train)) * F.col("_n"))
    n_val = F.floor(F.lit(float(val)) * F.col("_n"))
    split = (F.when(F.col("_rn") <= n_train, F.lit("train"))
             .when(F.col("_rn") <= n_train + n_val, F.lit("val")).otherwise(F.lit("test")))
    return r.withColumn("split", split).drop("_h", "_rk", "_rn", "_n")


def split_counts(manifest: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Label × split counts with per-label and grand totals (rollup);
    totals carry ``*``, a null label or split stays null."""
    return manifest.rollup(label, split).agg(
        F.count(F.lit(1)).alias("n"), F.grouping(label).alias("_l"), F.grouping(split).alias("_s")).select(
        F.when(F.col("_l") == 1, F.lit("*")).otherwise(F.col(label).cast("string")).alias("label"),
        F.when(F.col("_s") == 1, F.lit("*")).otherwise(F.col(split)).alias("split"), F.col("n").cast("bigint").alias("n"))


# ---------------------------------------------------------------- H15 / H16
def verify_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Full outer join on path → ok / changed / missing / extra."""
    m = manifest.select("path", F.col("sha256").alias("_m"))
    a = actual.select("path", F.col("sha256").alias("_a"))
    j = m.join(a, "path", "full_outer")
    status = (F.when(F.col("_a").isNull(), F.lit("missing")).when(F.col("_m").isNull(), F.lit("extra"))
              .when(F.col("_m") == F.col("_a"), F.lit("ok")).otherwise(F.lit("changed")))
    return j.select("path", status.alias("status"))


def duplicate_content(manifest: DataFrame) -> DataFrame:
    """Content hashes under several paths, and whether the copies fall
    in more than one split (leakage).  Only the (bounded) set of split names
    is gathered per hash, never the paths."""
    g = manifest.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("n_paths"),
        F.array_sort(F.collect_set("split")).alias("_splits"))
    return g.where(F.col("n_paths") > 1).select(
        "sha256", F.col("n_paths").cast("bigint").alias("n_paths"),
        F.array_join("_splits", ",").alias("splits"), (F.size("_splits") > 1).alias("leakage"))


# ---------------------------------------------------------------- H17
def train_curve(log: DataFrame, run: str = "run") -> DataFrame:
    """Per run the number of logged steps, last, mean and min loss."""
    return log.groupBy(run).agg(
        F.count(F.lit(1)).cast("bigint").alias("steps"),
        F.max("step").alias("last_step"),
        F.max_by("loss", "step").alias("last_loss"),
        F.avg("loss").alias("mean_loss"),
        F.min("loss").alias("min_loss"))
