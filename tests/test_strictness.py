"""Failures that must not pass: malformed answers, silent models, conflicting
updates, unreadable tables, and results that must not depend on the task layout."""

import json

import pytest
from pyspark.sql import functions as F

from claimtrail.functions.rank import global_running_sum
from claimtrail.operators import evaluate, evidence, validate, workflow
from claimtrail.sources import io as sio
from claimtrail.sources import state as sstate
from claimtrail.streaming import streams

GOOD = {"risk": "low", "summary": "s", "labels": ["a"], "citations": [{"source_id": "x", "quote": "q"}], "confidence": 0.5}


def test_answers_are_parsed_strictly(spark):
    good = json.dumps(GOOD)
    cases = {
        "good": (good, True), "spaces": (" \n" + good + "\n ", True), "quoted number": (json.dumps(GOOD | {"confidence": "0.5"}), True),
        "trailing": (good + " so there", False), "two": (good + good, False), "two with comma": (good + "," + good, False),
        "bracket": (good + "] x", False), "brace": (good + "} x", False), "single": (good.replace('"', "'"), False),
        "array": (f"[{good}]", False), "number as labels": (json.dumps(GOOD | {"labels": 3}), False),
        "unknown risk": (json.dumps(GOOD | {"risk": "severe"}), False), "no summary": (json.dumps({k: v for k, v in GOOD.items() if k != "summary"}), False),
        "empty": ("", False), "null": (None, False)}
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "case_id string, content string")
    got = {r.case_id: r.parse_ok for r in validate.parse_assessments(df).collect()}
    assert got == {k: v[1] for k, v in cases.items()}
    one = spark.createDataFrame([("c", json.dumps(GOOD | {"labels": "ab"}))], "case_id string, content string")
    r = validate.parse_assessments(one).first()
    assert r.parse_ok and r.labels == ["a", "b"]


def test_analysis_fails_closed(spark):
    headers = spark.createDataFrame([(c, "t") for c in ("ok", "silent", "severe", "unparsed")], "case_id string, title string")
    sources = spark.createDataFrame([(c, 0, "x", "q text") for c in ("ok", "silent", "severe", "unparsed")],
                                    "case_id string, pos long, source_id string, text string")
    rows = [("ok", "low", True), ("severe", "severe", True), ("unparsed", "low", False)]

    def classifier(h, s):
        return spark.createDataFrame([(c, r, "s", ["l"], [("x", "q")], 0.5, p) for c, r, p in rows],
                                     "case_id string, risk string, summary string, labels array<string>, "
                                     "citations array<struct<source_id:string,quote:string>>, confidence double, parse_ok boolean")
    got = {r.case_id: (r.state, r.reason) for r in workflow.analyze(headers, sources, classifier=classifier).collect()}
    assert got["ok"] == ("pending_approval", None)
    assert got["silent"] == ("failed", workflow.MSG_NO_ANSWER)
    assert got["severe"] == got["unparsed"] == ("failed", validate.MSG_INVALID_OUTPUT)


def test_running_sums_do_not_depend_on_tasks(spark):
    df = spark.range(1000).withColumn("v", F.lit(1.0))
    sums = global_running_sum(df, ["id"], "v", num_partitions=7).df
    assert sums.coalesce(1).where("running_sum <> rank").count() == 0
    assert sums.unionByName(sums).coalesce(2).where("running_sum <> rank").count() == 0


def test_null_predictions_and_labels(spark):
    preds = spark.createDataFrame([("a", None), ("a", "a"), ("b", "a")], "label string, pred string")
    got = {r.label: r for r in evaluate.per_class(preds, ["a", "b"]).collect()}
    assert got["a"].support == 2 and got["a"].recall == 0.5 and got["a"].precision == 0.5
    assert {(r.label, r.pred, r.n) for r in evaluate.confusion(preds, ["a", "b"]).collect() if r.n} == {
        ("a", "a", 1), ("b", "a", 1), ("a", "(other)", 1)}
    m = spark.createDataFrame([("x", "train"), (None, "train")], "label string, split string")
    assert {(r.label, r.split, r.n) for r in evaluate.split_counts(m).collect()} == {
        ("x", "train", 1), ("x", "*", 1), (None, "train", 1), (None, "*", 1), ("*", "*", 2)}


def test_selection_has_a_total_order_and_escaped_lengths(spark):
    rows = [("e", "r", i, "same", "c", "review", "high", "p", f"m{i}") for i in range(40)]
    schema = ("engagement_id string, repository_id string, pos long, observation_id string, check string, status string, "
              "severity string, path string, message string")
    for n in (1, 7):
        got = evidence.select_evidence(spark.createDataFrame(rows, schema).repartition(n), max_items=5).collect()
        assert sorted(r.message for r in got) == [f"m{i}" for i in range(5)]
    one = spark.createDataFrame([("e", "r", 0, "é😀", "c", "review", "high", "p", 'é"\\n')], schema)
    text = evidence.select_evidence(one).first().text
    want = {"observation_id": "é😀", "check": "c", "status": "review", "severity": "high", "path": "p", "message": 'é"\\n'}
    assert text == json.dumps(want, sort_keys=True)


def test_conflicting_updates(spark):
    schema = "case_id string, case_fingerprint string, state string, updated_seq long"
    state = spark.createDataFrame([("old", "A", "received", 1)], schema)
    updates = spark.createDataFrame([("old", "A", "approved", 2), ("old", "B", "published", 3),
                                     ("new", "X", "received", 5), ("new", "Y", "received", 6), ("new", "X", "approved", 7)], schema)
    new, refused = sstate.upsert_state(state, updates)
    assert {r.case_id: (r.case_fingerprint, r.state) for r in new.collect()} == {"old": ("A", "approved"), "new": ("X", "approved")}
    assert {(r.case_id, r.attempted_fingerprint, r.stored_fingerprint) for r in refused.collect()} == {("old", "B", "A"), ("new", "Y", "X")}


def test_writer_survives_a_leftover_version(spark, tmp_path):
    root = f"{tmp_path}/state"
    df = spark.createDataFrame([("a", 1)], "case_id string, n long")
    assert sstate.current_version(spark, root) is None
    assert sstate.write_state(spark, df, root) == 1
    df.write.parquet(f"{root}/v=2")                 # a writer that crashed before its marker
    assert sstate.current_version(spark, root) == 1
    assert sstate.write_state(spark, df, root) == 3 and sstate.read_state(spark, root).count() == 1


def test_sarif_without_runs_is_an_empty_report(spark, tmp_path):
    for name, text in (("a", '{"version": "2.1.0"}'), ("b", '{"runs": {}}'), ("c", "not json"), ("d", '{"runs": []}')):
        (tmp_path / f"{name}.sarif").write_text(text)
    ok, rejected = sio.read_sarif(spark, str(tmp_path))
    assert {r.doc_id[-7] for r in ok.collect()} == {"a", "d"} and {r.path[-7] for r in rejected.collect()} == {"b", "c"}


def test_publication_stops_at_an_unreadable_export_table(spark, tmp_path):
    requests = spark.createDataFrame([("c1", 1)], "case_id string, seq long")
    requests.write.parquet(f"{tmp_path}/in")
    state = spark.createDataFrame([("c1", "approved", "f", "a")],
                                  "case_id string, state string, case_fingerprint string, assessment_fp string")
    (tmp_path / "out" / "batch=00000099").mkdir(parents=True)
    (tmp_path / "out" / "batch=00000099" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        streams.stream_publish(streams.stream_files(spark, f"{tmp_path}/in", requests.schema), state,
                               f"{tmp_path}/out", f"{tmp_path}/ckpt")
