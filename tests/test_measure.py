"""I1-I5 with the published measurement rows as golden input."""

import pytest

from claimtrail.operators import measure

# The twelve published measurement rows (image, measured mm)
# and the single truth row.
RESULTS = [
    ("d500_a00_synth_r1_synthdots.png", 60.167), ("d500_a15_synth_r2_synthdots.png", 60.089),
    ("d500_a15_synth_r3_synthdots.png", 60.162), ("d500_a15_synth_r6_synthdots.png", 60.025),
    ("d500_a30_synth_r4_synthdots.png", 60.116), ("d500_a30_synth_r5_synthdots.png", 59.980),
    ("d700_a00_synth_r1_synthdots.png", 59.989), ("d700_a15_synth_r2_synthdots.png", 59.977),
    ("d700_a15_synth_r3_synthdots.png", 59.998), ("d700_a15_synth_r6_synthdots.png", 60.025),
    ("d700_a30_synth_r4_synthdots.png", 60.146), ("d700_a30_synth_r5_synthdots.png", 60.069),
]
TRUTH = [("synthdots", 60.0, 0)]


def test_published_error_report(spark):
    res = spark.createDataFrame(RESULTS + [("no_condition_synthdots.png", 1.0), ("d1_a1_x_r1_other.png", 2.0)],
                                "image string, measured_mm double")
    truth = spark.createDataFrame(TRUTH, "object string, true_mm double, truth_pos long")
    errs = measure.measurement_errors(res, truth)
    rows = {r.image: r for r in errs.collect()}
    assert len(rows) == 12
    r = rows["d500_a15_synth_r2_synthdots.png"]
    assert (r.dist, r.angle, r.light, r.repeat) == ("500", "15", "synth", "2")
    s = measure.error_summary(errs).first()
    assert s.n == 12 and round(s.median_pct, 4) == 0.0783 and round(s.p95_pct, 4) == 0.2783 and s.verdict == "PASS"


def test_first_truth_key_in_order_wins(spark):
    res = spark.createDataFrame([("d1_a2_l_r3_ab.png", 10.0)], "image string, measured_mm double")
    truth = spark.createDataFrame([("b", 5.0, 0), ("ab", 10.0, 1)], "object string, true_mm double, truth_pos long")
    assert measure.match_objects(res, truth).first().object == "b"


def test_rows_with_none_one_and_several_keys_stay(spark):
    long = "k" * 100 + "".join(map(str, range(60)))
    rows = [("d1_ab", 1.0), ("d1_ab", 1.0), ("d1_b", None), ("zz", 2.0), (None, 3.0), ("", 4.0), (f"x{long}ab", 5.0), (f"x{long[:-1]}y", 6.0)]
    truth = spark.createDataFrame([("ab", 10.0, 2), ("b", 5.0, 3), ("b", 6.0, 4), (long, 7.0, 1), (long + "q", 8.0, 0), (None, 1.0, 5), ("", 1.0, 6)],
                                  "object string, true_mm double, truth_pos long")
    res = spark.createDataFrame(rows, "image string, measured_mm double")
    key = lambda r: tuple(map(str, r))
    expected = [("d1_ab", 1.0, "ab", 10.0)] * 2 + [("d1_b", None, "b", 5.0), ("zz", 2.0, None, None), (None, 3.0, None, None), ("", 4.0, None, None),
                                                  (f"x{long}ab", 5.0, long, 7.0), (f"x{long[:-1]}y", 6.0, None, None)]
    assert sorted(map(tuple, measure.match_objects(res, truth).collect()), key=key) == sorted(expected, key=key)
    short = truth.where("length(object) < 100")
    assert sorted((tuple(r)[2] for r in measure.match_objects(res, short).collect()), key=str) == [None, None, None, None, "ab", "ab", "ab", "b"]


def test_names_meet_the_objects_in_one_shuffle(spark):
    """A name with one key is neither made distinct nor grouped: only names with several keys have a group."""
    res = spark.createDataFrame([(f"d1_a2_l_r3_P{i}x.png", 10.0) for i in range(50)], "image string, measured_mm double")
    truth = spark.createDataFrame([(f"P{i}x", 5.0, i) for i in range(50)], "object string, true_mm double, truth_pos long")
    m = measure.match_objects(res, truth)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and "Union" in plan and plan.count("Aggregate") == 1
    assert m.where("object = regexp_extract(image, '(P[0-9]+x)', 1)").count() == 50


def test_plane_distance_identity_and_scale(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 4.0)], "image long, x1 double, y1 double, x2 double, y2 double")
    ident = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "image long, h array<double>")
    assert measure.plane_distance(pts, ident).first().measured_mm == pytest.approx(5.0)
    proj = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 2.0])], "image long, h array<double>")
    assert measure.plane_distance(pts, proj).first().measured_mm == pytest.approx(2.5)


def test_reprojection_rms(spark):
    obs = spark.createDataFrame([(v, c, 0.0, 0.0) for v in range(10) for c in range(4)],
                                "view long, corner long, x double, y double")
    prj = spark.createDataFrame([(v, c, 0.3, 0.4) for v in range(10) for c in range(4)],
                                "view long, corner long, x double, y double")
    rows = {r.view: r for r in measure.reprojection_rms(obs, prj).collect()}
    assert rows["3"].rms_px == pytest.approx(0.5) and rows["*"].verdict == "PASS" and rows["*"].points == 40


def test_rejects_carry_no_names_and_meet_broadcast_objects(spark):
    """The names are searched, then only what is counted is written; a bounded number of objects comes to the rows."""
    results = spark.createDataFrame([("d1_a2_sun_r3_P1x", 1.0), ("P2x", 1.0), ("d1_a2_sun_r3", 1.0), (None, 1.0), ("P1x_P2x", 1.0)],
                                    "image string, measured_mm double")
    truth = spark.createDataFrame([("P1x", 1.0, 2), ("P2x", 2.0, 1)], "object string, true_mm double, truth_pos int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = measure.measurement_rejects(results, truth)
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert tuple(counts.first()) == (5, 2, 2)
        assert "image" not in plan and "broadcast" in plan
        kept = measure.match_objects(results, truth, keep=["measured_mm"])
        assert kept.columns == ["measured_mm", "object", "true_mm"]
        assert sorted(r.object or "" for r in kept.collect()) == ["", "", "P1x", "P2x", "P2x"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
