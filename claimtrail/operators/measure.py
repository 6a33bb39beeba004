"""Planar measurement error analysis.

``results(image, measured_mm)``, ``truth(object, true_mm, truth_pos)`` (the
truth file's row order), points and homographies as plain columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rank import global_rank
from ..functions.substring import anchors, keys_in, numbered
from ..session import written

# The condition pattern of image names and the acceptance
# limits (median and p95 relative error in percent; reprojection).
CONDITION_PATTERN = r"d(\d+)_a(\d+)_(\w+?)_r(\d+)"
MEDIAN_LIMIT_PCT = 2.0
P95_LIMIT_PCT = 4.0
MIN_VIEWS = 10
MAX_RMS_PX = 0.5
BROADCAST_BYTES = 128 << 20     # of truth objects that are sent to every executor instead of shuffling the names


def _project(h: Column, x: Column, y: Column):
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def plane_distance(points: DataFrame, homographies: DataFrame, image: str = "image") -> DataFrame:
    """Map both pixel points through the image's 3×3 homography
    (row-major ``h array<double>``, projective division) and take the
    Euclidean distance.  Equi-join on the image."""
    j = points.join(homographies.select(image, "h"), image)
    h = F.col("h")
    x1, y1 = _project(h, F.col("x1"), F.col("y1"))
    x2, y2 = _project(h, F.col("x2"), F.col("y2"))
    return j.select(image, F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2)).alias("measured_mm"))


def parse_condition(results: DataFrame, image: str = "image") -> DataFrame:
    """Distance, angle, light and repeat from the name; names without the
    pattern are dropped (and can be counted by the caller)."""
    m = F.regexp_extract(F.col(image), CONDITION_PATTERN, 0)
    return results.where(m != "").select(
        "*",
        F.regexp_extract(F.col(image), CONDITION_PATTERN, 1).alias("dist"),
        F.regexp_extract(F.col(image), CONDITION_PATTERN, 2).alias("angle"),
        F.regexp_extract(F.col(image), CONDITION_PATTERN, 3).alias("light"),
        F.regexp_extract(F.col(image), CONDITION_PATTERN, 4).alias("repeat"),
    )


def match_objects(results: DataFrame, truth: DataFrame, image: str = "image", keep: Sequence[str] | None = None) -> DataFrame:
    """The first truth object (in truth order) whose key occurs in the image
    name, by the exact substring keys of ``functions.substring``; names
    without one keep null columns.  ``keep``: the columns of ``results`` to return (default: all), so that no others
    are written and shuffled.

    Names are searched once and written with the keys that may stand in them; a row meets the objects
    once, and only rows with several such keys are grouped again."""
    first = written(truth.where(F.length("object") > 0).groupBy("object").agg(
        F.min_by(F.struct("true_mm", "truth_pos"), "truth_pos").alias("_v")).select(
        F.col("object").alias("_p"), F.col("_v.true_mm").alias("_mm"), F.col("_v.truth_pos").alias("_pos")), "truth")
    patterns = numbered(first, "_p")
    keys = anchors(results.select(F.col(image).alias("_t")).where(F.length("_t") > 0), patterns)
    long = not keys.where("_long").isEmpty()
    objects = keys.join(patterns, "_pid").join(first, "_p") if long else first.withColumn("_key", F.col("_p"))
    if not long and (first.agg(F.sum(F.octet_length("_p") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        objects = F.broadcast(objects)
    columns = list(keep or results.columns)
    carried = columns + [image] * (long and image not in columns)
    found = written(results.select(*carried, keys_in(keys)(F.col(image)).alias("_keys")), "names")

    def met(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", F.explode_outer("_keys").alias("_k"))
        same = F.col("_k") == F.col("_key")
        return rows.join(objects.select("_key", "_p", "_mm", "_pos"), same & F.contains(F.col(image), F.col("_p")) if long else same, "left")

    # a long key may stand for several objects
    one = F.size("_keys") <= (0 if long else 1)
    single = met(found.where(one)).select(*columns, F.col("_p").alias("object"), F.col("_mm").alias("true_mm"))
    several = met(found.where(~one).withColumn("_row", F.monotonically_increasing_id()))
    best = several.groupBy("_row").agg(
        F.first(F.struct(*columns)).alias("_r"),
        F.min_by(F.struct(F.col("_p").alias("object"), F.col("_mm").alias("true_mm")), F.col("_pos")).alias("_b"))
    return single.unionByName(best.select("_r.*", "_b.object", "_b.true_mm"))


def measurement_errors(results: DataFrame, truth: DataFrame, image: str = "image") -> DataFrame:
    """I3 (with I2): per matched row the object, condition fields, error in
    mm and relative error in percent.  Rows without an object or without
    the condition pattern are dropped, as in the reference."""
    m = match_objects(results, truth, image).where(F.col("object").isNotNull())
    p = parse_condition(m, image)
    err = F.col("measured_mm") - F.col("true_mm")
    return p.select(image, "object", "dist", "angle", "light", "repeat", "measured_mm", "true_mm",
                    err.alias("err_mm"), (F.lit(100.0) * F.abs(err) / F.col("true_mm")).alias("rel_pct"))


def measurement_rejects(results: DataFrame, truth: DataFrame, image: str = "image") -> DataFrame:
    """Rows I3 drops, counted by cause: no truth object in the name, or no
    condition pattern (the reference drops both silently)."""
    has_cond = F.regexp_extract(F.col(image), CONDITION_PATTERN, 0) != ""
    m = match_objects(results.select(image, has_cond.alias("_cond")), truth, image, keep=["_cond"])
    return m.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.sum(F.col("object").isNull().cast("long")).cast("bigint").alias("no_object"),
        F.sum((F.col("object").isNotNull() & ~F.col("_cond")).cast("long")).cast("bigint").alias("no_condition"))


def error_summary(errors: DataFrame, tie_break: str = "image") -> DataFrame:
    """I4: n, median (mean of the two middle values for even n), p95 =
    sorted[min(n−1, int(0.95·n))], and the verdict.  Exact, from one global
    rank; only the picked ranks are aggregated.  Which of equal errors has a rank does not matter: a hash of
    ``tie_break`` only keeps them spread over tasks."""
    values = written(errors.select("rel_pct", F.hash(tie_break).alias("_tie")), "errors")
    ranked = global_rank(values, ["rel_pct", "_tie"], table=True)
    n = ranked.n
    if n == 0:
        return errors.sparkSession.createDataFrame([], "n long, median_pct double, p95_pct double, verdict string")
    lo, hi = (n + 1) // 2, n // 2 + 1
    p95_rank = min(n - 1, int(0.95 * n)) + 1
    picks = ranked.df.where(F.col("rank").isin(lo, hi, p95_rank))
    one = picks.agg(
        F.lit(n).cast("bigint").alias("n"),
        ((F.max(F.when(F.col("rank") == lo, F.col("rel_pct"))) + F.max(F.when(F.col("rank") == hi, F.col("rel_pct"))))
         / 2.0).alias("median_pct"),
        F.max(F.when(F.col("rank") == p95_rank, F.col("rel_pct"))).alias("p95_pct"))
    verdict = F.when((F.col("median_pct") <= MEDIAN_LIMIT_PCT) & (F.col("p95_pct") <= P95_LIMIT_PCT),
                     F.lit("PASS")).otherwise(F.lit("FAIL"))
    return one.withColumn("verdict", verdict)


def reprojection_rms(observed: DataFrame, projected: DataFrame) -> DataFrame:
    """Per view sqrt(mean(dx²+dy²)) over corners (join on view, corner),
    plus an overall row (view ``*``) with the verdict views ≥ 10 and rms ≤ 0.5."""
    j = observed.join(projected.select("view", "corner", F.col("x").alias("px"), F.col("y").alias("py")),
                      ["view", "corner"])
    d2 = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)
    per = j.groupBy("view").agg(F.sqrt(F.avg(d2)).alias("rms_px"), F.count(F.lit(1)).cast("bigint").alias("points"),
                                F.sum(d2).alias("_s"))
    total = per.agg(F.lit("*").alias("view"), F.sqrt(F.sum("_s") / F.sum("points")).alias("rms_px"),
                    F.sum("points").cast("bigint").alias("points"), F.count(F.lit(1)).alias("_views"))
    total = total.withColumn("verdict", F.when((F.col("_views") >= MIN_VIEWS) & (F.col("rms_px") <= MAX_RMS_PX),
                                               F.lit("PASS")).otherwise(F.lit("FAIL"))).drop("_views")
    return per.select(F.col("view").cast("string").alias("view"), "rms_px", "points",
                      F.lit(None).cast("string").alias("verdict")).unionByName(total)
