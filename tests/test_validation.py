"""E1-E7 against hand-made rows (golden expectations of the reference's
tests restated on our own fixtures)."""

import itertools
import random


from claimtrail.operators import triage, validate


def cases(spark, rows):
    """rows: (case_id, title, [(source_id, text), ...])"""
    h = spark.createDataFrame([(c, t) for c, t, _ in rows], "case_id string, title string")
    s = spark.createDataFrame([(c, i, sid, txt) for c, _, srcs in rows for i, (sid, txt) in enumerate(srcs)],
                              "case_id string, pos long, source_id string, text string")
    return h, s


def test_input_rules_in_order(spark):
    h, s = cases(spark, [
        ("ok", "t", [("a", "x"), ("b", "y")]),
        (" ", "t", [("a", "x")]),
        ("no-title", "　", [("a", "x")]),
        ("blank-id", "t", [("a", "x"), ("\t", "y")]),
        ("dup", "t", [("a", "x"), ("a", "y")]),
        ("empty-text", "t", [("a", "x"), ("b", " \n\x1c")]),
        ("big", "t", [("a", "x" * 60), ("b", "y" * 41)]),
    ])
    h = h.unionByName(spark.createDataFrame([("none", "t")], "case_id string, title string"))
    got = {r.case_id: r.reason for r in validate.validate_cases(h, s, max_chars=100).collect()}
    assert got == {
        "ok": None, " ": "case_id is required", "no-title": "title is required",
        "blank-id": "source_id is required", "dup": "source_id values must be unique",
        "empty-text": "evidence text cannot be empty", "big": "evidence exceeds the configured size limit",
        "none": "at least one evidence source is required",
    }


def test_parse_assessments(spark):
    rows = [
        ("a", 1, '{"risk":"high","summary":"s","citations":[{"source_id":"x","quote":"q"}],"confidence":0.7}'),
        ("b", 1, '{"risk":"high","summary":"s","citations":[{"source_id":"x","quote":"q"}],"confidence":"0.7"}'),
        ("c", 1, '{"risk":"severe","summary":"s","citations":[],"confidence":0.7}'),
        ("d", 1, '{"risk":"low","summary":"s","citations":[{"source_id":"x"}],"confidence":0.7}'),
        ("e", 1, "not json"),
        ("f", 1, '[{"risk":"low"}]'),
        ("g", 1, '{"risk":"low","summary":"s","citations":[],"confidence":"high"}'),
        ("h", 1, '{"risk":"low","summary":"s","citations":[],"confidence":1, "labels":["a","b"]}'),
    ]
    df = spark.createDataFrame(rows, "case_id string, attempt int, content string")
    got = {r.case_id: (r.parse_ok, r.confidence) for r in validate.parse_assessments(df).collect()}
    assert got["a"] == (True, 0.7) and got["b"] == (True, 0.7)
    assert not got["c"][0] and not got["d"][0] and not got["e"][0] and not got["f"][0] and not got["g"][0]
    assert got["h"] == (True, 1.0)


def test_first_valid_attempt_repair(spark):
    bad = '{"risk":"low","summary":"The product is compliant.","citations":[{"source_id":"s","quote":"q"}],"confidence":0.5}'
    good = '{"risk":"low","summary":"Bounded evidence only.","citations":[{"source_id":"s","quote":"q"}],"confidence":0.5}'
    df = spark.createDataFrame([("x", 1, "{oops"), ("x", 2, good), ("y", 1, bad), ("y", 2, bad), ("y", 3, good),
                                ("z", 1, good)], "case_id string, attempt int, content string")
    out = {r.case_id: r for r in validate.first_valid_attempt(
        validate.parse_assessments(df), lambda d: validate.prohibited_claims_reason()).collect()}
    assert out["x"].accepted_attempt == 2 and out["x"].reason is None
    assert out["y"].accepted_attempt is None and out["y"].reason == "provider returned prohibited assurance semantics"
    assert out["z"].accepted_attempt == 1


def test_grounding(spark):
    h, s = cases(spark, [("c1", "t", [("log", "Service failed at night"), ("db", "all fine")])])
    a = spark.createDataFrame([
        ("c1", "ok", 0.5, [("log", "failed at")]),
    ], "case_id string, summary string, confidence double, citations array<struct<source_id:string,quote:string>>")
    assert validate.validate_assessments(a, s).first().reason is None
    for cites, reason in [
        ([("log", "not there")], "citation quote does not resolve in source: log"),
        ([("nope", "x")], "unknown citation source: nope"),
        ([("log", "failed"), ("db", "   ")], "citation quote does not resolve in source: db"),
        ([], "at least one grounded citation is required"),
    ]:
        a2 = spark.createDataFrame([("c1", "ok", 0.5, cites)], a.schema)
        assert validate.validate_assessments(a2, s).first().reason == reason
    a3 = spark.createDataFrame([("c1", "ok", 1.5, [("log", "failed")])], a.schema)
    assert validate.validate_assessments(a3, s).first().reason == "confidence must be between 0 and 1"


def test_prohibited_phrase_and_label(spark):
    a = spark.createDataFrame([
        ("p", ["ok"], "The system  is\n COMPLIANT now"),
        ("l", [" Certified "], "fine"),
        ("n", ["ok"], "Bounded triage of observed signals"),
    ], "case_id string, labels array<string>, summary string")
    got = {r.case_id: r.reason for r in validate.prohibited_claims(a).collect()}
    assert got == {"p": "assessment contains a prohibited assurance claim",
                   "l": "assessment contains a prohibited assurance label", "n": None}


def test_keyword_classifier_first_tier_and_quote(spark):
    h, s = cases(spark, [
        ("c", "t", [("a", "Critical credential leak confirmed"), ("b", "warning")]),
        ("h", "t", [("a", "line one\nUnauthorized access")]),
        ("m", "t", [("a", "Warning: degraded")]),
        ("l", "t", [("a", "\nstarts with a newline")]),
    ])
    got = {r.case_id: r for r in triage.keyword_classify(h, s).collect()}
    assert got["c"].risk == "critical" and got["h"].risk == "high" and got["m"].risk == "medium"
    assert got["l"].risk == "low"
    assert got["h"].citations[0].quote == "line one"
    assert got["l"].citations[0].quote == ""          # blank quote: fails grounding later
    assert got["c"].confidence == 0.8


def test_passage_overlap_matches_brute_force(spark):
    rnd = random.Random(7)
    alphabet = "ab c"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400))) for _ in range(40)]
    passages = []
    for i in range(60):
        t = texts[rnd.randrange(len(texts))]
        if len(t) > 5 and rnd.random() < 0.7:
            a = rnd.randrange(len(t) - 1)
            b = min(len(t), a + rnd.randint(1, 80))
            passages.append(t[a:b])
        else:
            passages.append("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))))
    p = spark.createDataFrame(list(enumerate(passages)), "passage_id long, passage string")
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    got = {(r.passage_id, r.text_id) for r in validate.passage_overlap(p, t).collect()}
    want = {(i, j) for (i, ps), (j, tx) in itertools.product(enumerate(passages), enumerate(texts))
            if ps and ps in tx}
    assert got == want
