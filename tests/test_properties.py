"""Property tests: operators against plain-Python row-at-a-time models (our
own) on random inputs, including whitespace and line-break edge characters."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from claimtrail.operators import chain, triage, validate

WS = ["", " ", "\t", "\n", "\x1c", "　", "\xa0", " "]
text = st.text(alphabet=st.sampled_from(list("ab fxé") + WS[1:]), max_size=12)
ident = st.sampled_from(["a", "b", " ", "", "c\t"])


def py_reason(case_id, title, sources, max_chars):
    if not case_id.strip():
        return "case_id is required"
    if not title.strip():
        return "title is required"
    if not sources:
        return "at least one evidence source is required"
    ids = [s for s, _ in sources]
    if any(not i.strip() for i in ids):
        return "source_id is required"
    if len(ids) != len(set(ids)):
        return "source_id values must be unique"
    if any(not t.strip() for _, t in sources):
        return "evidence text cannot be empty"
    if sum(len(t) for _, t in sources) > max_chars:
        return "evidence exceeds the configured size limit"
    return None


case = st.tuples(st.sampled_from(["k", " ", " "]), st.sampled_from(["t", "", "　"]),
                 st.lists(st.tuples(ident, text), max_size=4))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(case, min_size=1, max_size=6))
def test_input_rules_match_python_model(spark, cases):
    rows, srcs = [], []
    for i, (cid, title, sources) in enumerate(cases):
        key = f"{i}{cid}"
        rows.append((key, title))
        srcs += [(key, j, s, t) for j, (s, t) in enumerate(sources)]
    h = spark.createDataFrame(rows, "case_id string, title string")
    s = spark.createDataFrame(srcs, "case_id string, pos long, source_id string, text string")
    got = {r.case_id: r.reason for r in validate.validate_cases(h, s, max_chars=20).collect()}
    want = {f"{i}{cid}": py_reason(f"{i}{cid}", title, sources, 20) for i, (cid, title, sources) in enumerate(cases)}
    assert got == want


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(text, min_size=1, max_size=3), min_size=1, max_size=5))
def test_keyword_quote_matches_python_model(spark, cases):
    srcs = [(str(i), j, f"s{j}", t) for i, texts in enumerate(cases) for j, t in enumerate(texts)]
    h = spark.createDataFrame([(str(i), "t") for i in range(len(cases))], "case_id string, title string")
    s = spark.createDataFrame(srcs, "case_id string, pos long, source_id string, text string")
    got = {r.case_id: r.citations[0].quote for r in triage.keyword_classify(h, s).collect()}
    for i, texts in enumerate(cases):
        lines = texts[0].splitlines()
        want = lines[0][:240] if lines else ""
        assert got[str(i)] == want


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.text(alphabet="ab\"\\é", max_size=6)), min_size=1, max_size=12))
def test_chain_hashes_match_python_model(spark, events):
    rows = [(c, i, 1000 + i, e, "case", {"k": e}) for i, (c, e) in enumerate(events)]
    df = spark.createDataFrame(rows, "chain string, seq long, ts_us long, event string, case_id string, "
                                     "details map<string,string>")
    got = {r.seq: r.event_hash for r in chain.chain_append(df).collect()}

    def canon(v):
        v = None if v is None else str(v)
        return "~" if v is None else f"{len(v)}:{v}"
    prev = {}
    for c, seq, ts, e, cid, det in rows:
        p = prev.get(c, "0" * 64)
        det_text = f"{len(det)}#" + "".join(canon(k) + canon(v) for k, v in sorted(det.items()))
        record = canon(cid) + canon(det_text) + canon(e) + canon(seq) + canon(ts)
        h = hashlib.sha256((record + canon(p)).encode()).hexdigest()
        assert got[seq] == h
        prev[c] = h


SEVS = ["critical", "high", "medium", "low", "info", "weird"]
RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(SEVS), st.integers(0, 60)), min_size=0, max_size=40),
       st.integers(1, 12), st.integers(50, 1500))
def test_selection_matches_python_model(spark, items, max_items, max_chars):
    import json
    from claimtrail.operators import evidence
    rows = [("e", "r", i, f"o{i:03d}", "c", "review", sev, "p", "m" * n) for i, (sev, n) in enumerate(items)]
    obs = spark.createDataFrame(rows, "engagement_id string, repository_id string, pos long, observation_id string, "
                                      "check string, status string, severity string, path string, message string")
    got = [r.observation_id for r in evidence.select_evidence(obs, max_items, max_chars).orderBy("sel_pos").collect()]
    ordered = sorted(rows, key=lambda r: (RANK.get(r[6], 2), r[3]))
    want, total = [], 0
    for r in ordered:
        text = json.dumps({"observation_id": r[3], "check": r[4], "status": r[5], "severity": r[6], "path": r[7],
                           "message": r[8]}, sort_keys=True)
        if len(want) >= max_items or total + len(text) > max_chars:
            break
        want.append(r[3])
        total += len(text)
    assert got == want


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(
    st.tuples(st.sampled_from(SEVS + [None]), st.sampled_from(["review", "pass", None])),
    st.just("not json")), min_size=1, max_size=25))
def test_triage_matches_python_model(spark, items):
    import json
    texts = []
    for it in items:
        if it == "not json":
            texts.append("not json")
        else:
            d = {}
            if it[0] is not None:
                d["severity"] = it[0]
            if it[1] is not None:
                d["status"] = it[1]
            texts.append(json.dumps(d))
    s = spark.createDataFrame([("c", i, f"s{i}", t) for i, t in enumerate(texts)],
                              "case_id string, pos long, source_id string, text string")
    got = triage.triage(s.select("case_id").distinct(), s).first()
    order = {"info": 0, "low": 0, "medium": 1, "high": 2, "critical": 3}
    parsed = []
    for i, t in enumerate(texts):
        try:
            obj = json.loads(t)
        except json.JSONDecodeError:
            obj = {"severity": "low", "status": "review"}
        parsed.append((f"s{i}", obj))
    review = [p for p in parsed if str(p[1].get("status")) == "review"]
    cand = review or parsed
    risk = max(order.get(str(o.get("severity")), 1) for _, o in cand)
    assert got.risk == ["low", "medium", "high", "critical"][risk]
    assert [c.source_id for c in got.citations] == [sid for sid, _ in cand[:10]]
    assert got.n_review == len(review)
