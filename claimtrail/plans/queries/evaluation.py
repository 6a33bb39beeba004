"""Registered queries, group H (evaluation): H2_accuracy, H3_confusion, H4_per_class, H5_macro_f1, H6_selective_accuracy, H7_risk_coverage, H8_ece, H9_brier, H10_compare_runs, H11_acceptance, H12_running_accuracy, H13_stratified_split, H14_split_counts, H15_verify_manifest, H16_duplicate_content, H17_train_curve, H1_golden_eval, H1_golden_eval_grounded."""

from ._shared import *  # noqa: F401,F403
from ._shared import register  # noqa: F401


@register("H2_accuracy", f"""
WITH {_f3_sql(0)}
SELECT count(*) AS n, avg(CAST(correct AS DOUBLE)) AS accuracy, round(avg(confidence), 6) AS mean_confidence,
       avg(CAST(free_top_is_letter AS DOUBLE)) AS letter_rate FROM preds
""")
def q_h2(spark, sf_dir):
    return evaluate.accuracy(fixtures.predictions(spark, sf_dir)).withColumn(
        "mean_confidence", F.round("mean_confidence", 6))


@register("H3_confusion", f"""
WITH {_f3_sql(0)},
  cnt AS (SELECT label, pred, count(*) AS n FROM preds GROUP BY ALL)
SELECT a.c AS label, b.c AS pred, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM {_LABELS_SQL} a JOIN {_LABELS_SQL} b ON TRUE LEFT JOIN cnt ON cnt.label = a.c AND cnt.pred = b.c
""")
def q_h3(spark, sf_dir):
    return evaluate.confusion(fixtures.predictions(spark, sf_dir), fixtures.CLASS_NAMES)


@register("H4_per_class", f"""
WITH {_f3_sql(0)}, {_PER_CLASS_SQL}
SELECT label, precision, recall, f1, CAST(tp + fn AS BIGINT) AS support FROM f
""")
def q_h4(spark, sf_dir):
    return evaluate.per_class(fixtures.predictions(spark, sf_dir), fixtures.CLASS_NAMES)


@register("H5_macro_f1", f"""
WITH {_f3_sql(0)}, {_PER_CLASS_SQL}
SELECT round(avg(f1), 6) AS macro_f1 FROM f
""")
def q_h5(spark, sf_dir):
    return evaluate.macro_f1(evaluate.per_class(fixtures.predictions(spark, sf_dir), fixtures.CLASS_NAMES)).select(
        F.round("macro_f1", 6).alias("macro_f1"))


@register("H6_selective_accuracy", f"""
WITH {_SCORED},
  k AS (SELECT max(n) AS n, CAST(round_even(0.9::DOUBLE * max(n), 0) AS BIGINT) AS k FROM rk)
SELECT k.n, k.k,
       coalesce(sum(CASE WHEN rank <= k.k THEN CAST(correct AS DOUBLE) END) / greatest(k.k, 1), 0.0)
         AS selective_accuracy,
       coalesce(sum(CASE WHEN rank > k.k THEN CAST(correct AS DOUBLE) END), 0.0) / greatest(k.n - k.k, 1)
         AS abstained_accuracy
FROM rk, k GROUP BY k.n, k.k
""")
def q_h6(spark, sf_dir):
    return evaluate.selective_accuracy(fixtures.scored(spark, sf_dir), 0.9, "key")


@register("H7_risk_coverage", f"""
WITH {_SCORED},
  cov AS (SELECT unnest([1.0, 0.95, 0.9, 0.8, 0.7, 0.5]::DOUBLE[]) AS coverage),
  ks AS (SELECT coverage, greatest(1, CAST(round_even(coverage * (SELECT count(*) FROM sc), 0) AS BIGINT)) AS kept,
                (SELECT count(*) FROM sc) AS n FROM cov)
SELECT ks.coverage, ks.kept,
       max(CASE WHEN rank = ks.kept THEN confidence END) AS threshold,
       sum(CASE WHEN rank <= ks.kept THEN CAST(correct AS DOUBLE) END) / ks.kept AS selective_accuracy,
       CASE WHEN ks.n > ks.kept THEN sum(CASE WHEN rank > ks.kept THEN CAST(correct AS DOUBLE) END) / (ks.n - ks.kept)
       END AS abstained_accuracy
FROM ks JOIN rk ON TRUE GROUP BY ks.coverage, ks.kept, ks.n
""")
def q_h7(spark, sf_dir):
    return evaluate.risk_coverage(fixtures.scored(spark, sf_dir), tie_break="key")


@register("H8_ece", f"""
WITH {_SCORED},
  b AS (SELECT least(9, CAST(floor(confidence * 10.0) AS INTEGER)) AS bin, count(*) AS nb,
               avg(CAST(correct AS DOUBLE)) AS acc, avg(confidence) AS conf FROM sc GROUP BY 1)
SELECT round(sum(nb * abs(acc - conf)) / sum(nb), 6) AS ece FROM b
""")
def q_h8(spark, sf_dir):
    return evaluate.ece(fixtures.scored(spark, sf_dir)).select(F.round("ece", 6).alias("ece"))


@register("H9_brier", f"""
WITH {_SCORED}
SELECT round(avg(pow(confidence - CAST(correct AS DOUBLE), 2)), 6) AS brier FROM sc
""")
def q_h9(spark, sf_dir):
    return evaluate.brier(fixtures.scored(spark, sf_dir)).select(F.round("brier", 6).alias("brier"))


@register("H10_compare_runs", f"""
WITH {_f3_sql(0)}, b AS (SELECT * FROM preds),
  {_f3_sql(20).replace('e AS (', 'e2 AS (').replace('FROM e)', 'FROM e2)').replace('c AS (', 'c2 AS (')
   .replace('FROM c)', 'FROM c2)').replace('m AS (', 'm2 AS (').replace('FROM m)', 'FROM m2)')
   .replace('x AS (', 'x2 AS (').replace('FROM x)', 'FROM x2)').replace('pr AS (', 'pr2 AS (')
   .replace('FROM pr)', 'FROM pr2)').replace('preds AS (', 'preds2 AS (')},
  j AS (SELECT b.pred AS pa, b.confidence AS ca, p2.pred AS pb, p2.confidence AS cb
        FROM b JOIN preds2 p2 USING (key))
SELECT bool_and(pa = pb) AS identical_predictions, round(max(abs(ca - cb)), 6) AS max_abs_conf_delta,
       bool_and(pa = pb AND ca = cb) AS identical_content, CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b
FROM j
""")
def q_h10(spark, sf_dir):
    out = evaluate.compare_runs(fixtures.predictions(spark, sf_dir, "a"), fixtures.predictions(spark, sf_dir, "b"))
    return out.withColumn("max_abs_conf_delta", F.round("max_abs_conf_delta", 6))


@register("H11_acceptance", f"""
WITH {_f1_sql(20, '_b')}, {_f1_sql(0, '_t')},
  s AS (SELECT (SELECT avg(f1) FROM f_b) AS base, (SELECT avg(f1) FROM f_t) AS tuned)
SELECT round(base, 6) AS base, round(tuned, 6) AS tuned, round((tuned - base) * 100.0, 6) AS delta_points,
       CASE WHEN (tuned - base) * 100.0 >= 10.0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s
""")
def q_h11(spark, sf_dir):
    base = evaluate.macro_f1(evaluate.per_class(fixtures.predictions(spark, sf_dir, "b"), fixtures.CLASS_NAMES))
    tuned = evaluate.macro_f1(evaluate.per_class(fixtures.predictions(spark, sf_dir, "a"), fixtures.CLASS_NAMES))
    return evaluate.acceptance(base, tuned).select(
        *[F.round(c, 6).alias(c) for c in ("base", "tuned", "delta_points")], "verdict")


_H12_SQL = """
WITH sc AS (SELECT event_id AS key, value > 50 AS correct FROM events),
  r AS (SELECT row_number() OVER (ORDER BY key) AS row,
               sum(CAST(correct AS DOUBLE)) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
               count(*) OVER () AS n FROM sc)
SELECT row, cum / row AS running_accuracy FROM r WHERE row % 25 = 0 OR row = n
"""


@register("H12_running_accuracy", _H12_SQL)
def q_h12(spark, sf_dir):
    return evaluate.running_accuracy(fixtures.scored(spark, sf_dir), [F.col("key")])


@register("H12_running_accuracy_relaid", _H12_SQL)
def q_h12r(spark, sf_dir):
    """The same with several ranges read by one task."""
    return evaluate.running_accuracy(fixtures.scored(spark, sf_dir), [F.col("key")]).coalesce(2)


@register("H13_stratified_split", f"""
WITH {_SPLIT_SQL}
SELECT vec_id, label, split FROM sp
""")
def q_h13(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"))
    return evaluate.stratified_split(e, "label", "vec_id").select("vec_id", "label", "split")


@register("H14_split_counts", f"""
WITH {_SPLIT_SQL}
SELECT coalesce(CAST(label AS VARCHAR), '*') AS label, coalesce(split, '*') AS split, count(*) AS n
FROM sp GROUP BY ROLLUP (label, split)
""")
def q_h14(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"))
    return evaluate.split_counts(evaluate.stratified_split(e, "label", "vec_id"))


@register("H15_verify_manifest", f"""
WITH {_MANIFEST_SQL}
SELECT coalesce(man.path, act.path) AS path,
       CASE WHEN act.path IS NULL THEN 'missing' WHEN man.path IS NULL THEN 'extra'
            WHEN man.sha256 = act.sha256 THEN 'ok' ELSE 'changed' END AS status
FROM man FULL OUTER JOIN act ON man.path = act.path
""")
def q_h15(spark, sf_dir):
    m, a = fixtures.doc_manifest(spark, sf_dir)
    return evaluate.verify_manifest(m, a)


@register("H16_duplicate_content", f"""
WITH {_MANIFEST_SQL},
  g AS (SELECT sha256, count(*) AS n_paths, list_sort(list_distinct(list(split))) AS s FROM man GROUP BY sha256)
SELECT sha256, n_paths, array_to_string(s, ',') AS splits, len(s) > 1 AS leakage FROM g WHERE n_paths > 1
""")
def q_h16(spark, sf_dir):
    m, _ = fixtures.doc_manifest(spark, sf_dir)
    return evaluate.duplicate_content(m)


@register("H17_train_curve", """
SELECT user_id AS run, count(*) AS steps, max(event_id) AS last_step, arg_max(value / 100, event_id) AS last_loss,
       round(avg(value / 100), 6) AS mean_loss, min(value / 100) AS min_loss
FROM events GROUP BY user_id
""")
def q_h17(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events")
    log = ev.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), (F.col("value") / 100).alias("loss"))
    return evaluate.train_curve(log).withColumn("mean_loss", F.round("mean_loss", 6))


@register("H1_golden_eval", f"""
WITH g AS (SELECT CAST(doc_id AS VARCHAR) AS case_id,
                  CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'high' ELSE 'low' END AS expected FROM labels),
  d AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, text, source FROM documents),
  v AS (SELECT case_id,
          CASE WHEN contains(lower(text), 'credential leak') OR contains(lower(text), 'remote code')
                    OR contains(lower(text), 'critical') THEN 'critical'
               WHEN contains(lower(text), 'failed') OR contains(lower(text), 'exposed')
                    OR contains(lower(text), 'unauthorized') THEN 'high'
               WHEN contains(lower(text), 'warning') OR contains(lower(text), 'stale')
                    OR contains(lower(text), 'degraded') THEN 'medium' ELSE 'low' END AS risk,
          {O.blank('source')} OR {O.blank('text')} OR length(text) > 100000 AS rejected
        FROM d)
SELECT count(*) AS cases,
       coalesce(avg(CASE WHEN NOT coalesce(v.rejected, true) AND v.risk = g.expected THEN 1.0 ELSE 0.0 END), 0.0)
         AS risk_accuracy,
       coalesce(avg(CASE WHEN NOT coalesce(v.rejected, true) THEN 1.0 ELSE 0.0 END), 0.0) AS citation_validity
FROM g LEFT JOIN v USING (case_id)
""")
def q_h1(spark, sf_dir):
    headers, sources, golden = fixtures.document_cases(spark, sf_dir)
    assessed = workflow.analyze(headers, sources)
    ok = assessed.where(F.col("input_reason").isNull())
    return evaluate.golden_eval(ok, golden)


@register("H1_golden_eval_grounded", """
WITH g AS (SELECT CAST(doc_id AS VARCHAR) AS case_id FROM labels),
  d AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, text, source FROM documents),
  v AS (SELECT case_id,
               NOT (source IS NULL OR regexp_matches(source, '^\\s*$') OR length(text) > 100000) AS ok,
               substring(regexp_split_to_array(text, '\\r\\n|[\\n\\r]')[1], 1, 240) AS quote, text FROM d)
SELECT count(*) AS cases,
       coalesce(avg(CASE WHEN coalesce(v.ok, false) THEN 1.0 ELSE 0.0 END), 0.0) AS citation_validity,
       coalesce(avg(CASE WHEN coalesce(v.ok, false) AND NOT regexp_matches(v.quote, '^\\s*$')
                         AND contains(v.text, v.quote) THEN 1.0 ELSE 0.0 END), 0.0) AS grounded_validity
FROM g LEFT JOIN v USING (case_id)
""")
def q_h1g(spark, sf_dir):
    """Golden evaluation with the re-checked (grounded) citation validity."""
    headers, sources, golden = fixtures.document_cases(spark, sf_dir)
    assessed = workflow.analyze(headers, sources)
    ok = assessed.where(F.col("input_reason").isNull())
    return evaluate.golden_eval(ok, golden, sources).select("cases", "citation_validity", "grounded_validity")
