"""Registered queries, group I (measurement): I3_measurement_errors, I2_parse_condition, I4_error_summary, I1_plane_distance, I5_reprojection_rms, I3_measurement_rejects."""

from ._shared import *  # noqa: F401,F403
from ._shared import register  # noqa: F401


@register("I3_measurement_errors", f"""
WITH {_MEAS_SQL}
SELECT image, object, dist, angle, light, "repeat", measured_mm, true_mm, err_mm, rel_pct FROM errs
""")
def q_i3(spark, sf_dir):
    return measure.measurement_errors(fixtures.measurement_results(spark, sf_dir),
                                      fixtures.measurement_truth(spark, sf_dir))


@register("I2_parse_condition", r"""
WITH res AS (SELECT CASE WHEN l_linenumber = 7 THEN 'img_P' || CAST(l_partkey AS VARCHAR) || 'x.png'
                      ELSE printf('d%d_a%d_%s_r%d-%d-%d_P%dx.png', l_orderkey % 900 + 100, l_linenumber * 15 % 90,
                                  CASE WHEN l_returnflag = 'A' THEN 'lamp' ELSE 'sun' END, l_orderkey, l_linenumber,
                                  l_suppkey, l_partkey) END AS image FROM lineitem)
SELECT image, regexp_extract(image, 'd(\d+)_a(\d+)_(\w+?)_r(\d+)', 1) AS dist,
       regexp_extract(image, 'd(\d+)_a(\d+)_(\w+?)_r(\d+)', 2) AS angle,
       regexp_extract(image, 'd(\d+)_a(\d+)_(\w+?)_r(\d+)', 3) AS light,
       regexp_extract(image, 'd(\d+)_a(\d+)_(\w+?)_r(\d+)', 4) AS "repeat"
FROM res WHERE regexp_matches(image, 'd(\d+)_a(\d+)_(\w+?)_r(\d+)')
""")
def q_i2(spark, sf_dir):
    return measure.parse_condition(fixtures.measurement_results(spark, sf_dir)).select(
        "image", "dist", "angle", "light", "repeat")


@register("I4_error_summary", f"""
WITH {_MEAS_SQL},
  r AS (SELECT rel_pct, row_number() OVER (ORDER BY rel_pct, image) AS rn, count(*) OVER () AS n FROM errs),
  s AS (SELECT max(n) AS n, quantile_cont(rel_pct, 0.5) AS median_pct,
               max(CASE WHEN rn = least(n - 1, CAST(floor(0.95::DOUBLE * n) AS BIGINT)) + 1 THEN rel_pct END) AS p95_pct
        FROM r)
SELECT n, round(median_pct, 6) AS median_pct, round(p95_pct, 6) AS p95_pct,
       CASE WHEN median_pct <= 2.0 AND p95_pct <= 4.0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s
""")
def q_i4(spark, sf_dir):
    errs = measure.measurement_errors(fixtures.measurement_results(spark, sf_dir),
                                      fixtures.measurement_truth(spark, sf_dir))
    return _round_summary(measure.error_summary(errs))


@register("I1_plane_distance", """
WITH e AS (SELECT vec_id AS image, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  p AS (SELECT image,
               [1.0 + v[1] * 0.01, v[2] * 0.01, v[3], v[4] * 0.01, 1.0 + v[5] * 0.01, v[6], v[7] * 0.001,
                v[8] * 0.001, 1.0]::DOUBLE[] AS h,
               v[11] * 100 + 500 AS x1, v[12] * 100 + 500 AS y1, v[13] * 100 + 500 AS x2, v[14] * 100 + 500 AS y2
        FROM e),
  q AS (SELECT image,
               (h[1] * x1 + h[2] * y1 + h[3]) / (h[7] * x1 + h[8] * y1 + h[9]) AS u1,
               (h[4] * x1 + h[5] * y1 + h[6]) / (h[7] * x1 + h[8] * y1 + h[9]) AS w1,
               (h[1] * x2 + h[2] * y2 + h[3]) / (h[7] * x2 + h[8] * y2 + h[9]) AS u2,
               (h[4] * x2 + h[5] * y2 + h[6]) / (h[7] * x2 + h[8] * y2 + h[9]) AS w2 FROM p)
SELECT image, round(sqrt(pow(u1 - u2, 2) + pow(w1 - w2, 2)), 6) AS measured_mm FROM q
""")
def q_i1(spark, sf_dir):
    pts, homs = fixtures.plane_points(spark, sf_dir)
    return measure.plane_distance(pts, homs).withColumn("measured_mm", F.round("measured_mm", 6))


@register("I5_reprojection_rms", """
WITH e AS (SELECT label AS view, vec_id AS corner, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  d AS (SELECT view, pow(v[1] - (v[1] + v[3] * 0.01), 2) + pow(v[2] - (v[2] + v[4] * 0.01), 2) AS d2 FROM e),
  per AS (SELECT CAST(view AS VARCHAR) AS view, sqrt(avg(d2)) AS rms_px, count(*) AS points, sum(d2) AS s FROM d
          GROUP BY view)
SELECT view, round(rms_px, 6) AS rms_px, points, NULL::VARCHAR AS verdict FROM per
UNION ALL
SELECT '*', round(sqrt(sum(s) / sum(points)), 6), CAST(sum(points) AS BIGINT),
       CASE WHEN count(*) >= 10 AND sqrt(sum(s) / sum(points)) <= 0.5 THEN 'PASS' ELSE 'FAIL' END FROM per
""")
def q_i5(spark, sf_dir):
    obs, prj = fixtures.reprojection(spark, sf_dir)
    return measure.reprojection_rms(obs, prj).withColumn("rms_px", F.round("rms_px", 6))


@register("I3_measurement_rejects", r"""
WITH res AS (SELECT CASE WHEN l_linenumber = 7 THEN 'img_P' || CAST(l_partkey AS VARCHAR) || 'x.png'
                      ELSE printf('d%d_a%d_%s_r%d-%d-%d_P%dx.png', l_orderkey % 900 + 100, l_linenumber * 15 % 90,
                                  CASE WHEN l_returnflag = 'A' THEN 'lamp' ELSE 'sun' END, l_orderkey, l_linenumber,
                                  l_suppkey, l_partkey) END AS image, l_partkey FROM lineitem)
SELECT count(*) AS "rows",
       CAST(sum(CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part) THEN 1 ELSE 0 END) AS BIGINT) AS no_object,
       CAST(sum(CASE WHEN l_partkey IN (SELECT p_partkey FROM part)
                      AND NOT regexp_matches(image, 'd(\d+)_a(\d+)_(\w+?)_r(\d+)') THEN 1 ELSE 0 END) AS BIGINT)
         AS no_condition
FROM res
""")
def q_i3r(spark, sf_dir):
    """Measurement rows dropped by I3, by cause."""
    return measure.measurement_rejects(fixtures.measurement_results(spark, sf_dir),
                                       fixtures.measurement_truth(spark, sf_dir))
