"""J1-J7 and A1-A10."""

import json

from pyspark.sql import functions as F

from claimtrail.operators import report
from claimtrail.sources import io as sio
from claimtrail.sources import state as sstate


def test_pilot_metrics(spark):
    key = "engagement_id string, repository_id string"
    obs = spark.createDataFrame([("e", "r", "review", "high"), ("e", "r", "pass", "info"), ("e", "r", "review", "low")],
                                f"{key}, status string, severity string")
    reports = spark.createDataFrame([("e", "r"), ("e", "empty")], key)
    a = spark.createDataFrame([("e", "r", "high", 1.0, [("x", "q")])],
                              f"{key}, risk string, confidence double, citations array<struct<source_id:string,quote:string>>")
    none = spark.createDataFrame([], f"{key}, network_isolated boolean")
    got = {r.repository_id: r for r in report.pilot_metrics(reports, obs, a, none).collect()}
    m, empty = got["r"], got["empty"]
    assert m.all_isolated and m.executions == 0 and m.observations == 3 and (m.to_review, m.passed) == (2, 1)
    assert m.status_counts == "pass=1,review=2" and m.severity_counts == "high=1,info=1,low=1"
    assert empty.observations == 0 and empty.status_counts == "" and empty.risk is None
    assert not any(m[c] for c in report.NOT_CLAIMED) and m.audit_verified is None
    ex = spark.createDataFrame([("e", "r", True, "b"), ("e", "r", False, "a")], f"{key}, network_isolated boolean, scanner string")
    ok = spark.createDataFrame([("e", "r", True)], f"{key}, valid boolean")
    ms = spark.createDataFrame([("e", "r", 1250.0)], f"{key}, duration_ms double")
    full = report.pilot_metrics(reports, obs, a, ex, ok, ms)
    m = full.where("repository_id = 'r'").first()
    assert not m.all_isolated and m.scanners == "a,b" and m.audit_verified and m.provider_duration_ms == 1250.0
    text = {r.repository_id: r.summary_md for r in report.management_summary(full).collect()}
    assert "| risk | high |" in text["r"] and "no norm is attested" in text["r"] and "| findings | 0 |" in text["empty"]


def test_evidence_pack_holds_every_observation(spark):
    key = "engagement_id string, repository_id string"
    cases = spark.createDataFrame([("c", "title", "e", "r"), ("d", "none", "e", "s")], f"case_id string, title string, {key}")
    obs = spark.createDataFrame([("e", "r", i, f"o{i}", "x ``` y") for i in range(250)],
                                f"{key}, pos long, observation_id string, message string")
    a = spark.createDataFrame([("c", "low", 1.0, "sum", [("s", "x")])],
                              "case_id string, risk string, confidence double, summary string, "
                              "citations array<struct<source_id:string,quote:string>>")
    st = spark.createDataFrame([("c", "approved")], "case_id string, state string")
    rows = report.evidence_pack(cases, obs, a, st).collect()
    cover = {r.case_id: r.page_md for r in rows if r.page == 0}
    assert "state: approved" in cover["c"] and "Not assessed." in cover["d"]
    pages = sorted((r.page, r.first_pos, r.n_items, r.page_md) for r in rows if r.page)
    assert [p[:3] for p in pages] == [(1, 0, 100), (2, 100, 100), (3, 200, 50)]
    assert all(p[3].count("```") == 2 for p in pages)
    ids = [o["observation_id"] for p in pages for o in json.loads(p[3].removeprefix("```json").removesuffix("```"))]
    assert ids == [f"o{i}" for i in range(250)]


def test_latency_percentiles(spark):
    rows = [("p", float(v), v) for v in range(1, 101)] + [("q", 5.0, 1)]
    d = spark.createDataFrame(rows, "name string, duration_ms double, ts long")
    got = {r.name: r for r in report.latency(d).collect()}
    assert got["p"].p50 == 50.0 and got["p"].p95 == 95.0 and got["p"].last == 100.0 and got["q"]["count"] == 1


def test_markdown_table(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.25)], "label string, f1 double")
    md = report.markdown_table(df, ["label", "f1"], ["label"], {"f1": "%.3f"}).first().table_md
    assert md == "| label | f1 |\n|---|---|\n| a | 0.250 |\n| b | 0.500 |"


def test_read_cases_and_scope(spark, tmp_path):
    p = tmp_path / "case.json"
    p.write_text(json.dumps({"case_id": "i1", "title": "Incident", "sources": [
        {"source_id": "a", "text": "x"}, {"source_id": "b", "text": "y"}]}, indent=2))
    h, s = sio.explode_cases(sio.read_cases(spark, str(p), multiline=True))
    assert h.first().case_id == "i1" and [r.source_id for r in s.orderBy("pos").collect()] == ["a", "b"]
    scope_file = tmp_path / "scope.json"
    scope_file.write_text(json.dumps({"version": 1, "engagement_id": "e", "customer": "c", "expires_on": "2030-01-01",
                                      "egress": "deny", "repositories": [{"repository_id": "r", "path": "../r",
                                                                          "allowed_checks": ["semgrep"]}]}))
    sc, repos = sio.read_scope(spark, str(scope_file))
    assert str(sc.first().expires_on) == "2030-01-01" and repos.first().allowed_checks == ["semgrep"]


def test_read_sarif_size_cap(spark, tmp_path):
    d = tmp_path / "sarif"
    d.mkdir()
    (d / "small.sarif").write_text(json.dumps({"runs": [{"results": [{"ruleId": "a"}]}]}))
    (d / "big.sarif").write_text(json.dumps({"runs": [{"results": [{"ruleId": "a" * 500}]}]}))
    (d / "noruns.sarif").write_text(json.dumps({"version": "2.1.0"}))       # an empty report
    (d / "wrong.sarif").write_text(json.dumps({"runs": "none"}))
    ok, rejected = sio.read_sarif(spark, str(d), max_bytes=200)
    assert sorted(r.doc_id.rsplit("/", 1)[-1] for r in ok.collect()) == ["noruns.sarif", "small.sarif"]
    assert sorted(r.reason for r in rejected.collect()) == [
        "SARIF report exceeds the configured size limit", "SARIF report must contain a runs array"]


def test_read_lines_numbers_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"l{i}" for i in range(1, 51)) + "\n")
    got = [(r.line_no, r.line) for r in sio.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [(i, f"l{i}") for i in range(1, 51)]


def test_file_manifest(spark, tmp_path):
    for label, name, data in [("cat", "a.JPG", b"1234"), ("cat", "b.txt", b"x"), ("dog", "c.png", b"xy")]:
        (tmp_path / label).mkdir(exist_ok=True)
        (tmp_path / label / name).write_bytes(data)
    got = {r.path: r for r in sio.file_manifest(spark, str(tmp_path)).collect()}
    assert set(got) == {"cat/a.JPG", "dog/c.png"} and got["cat/a.JPG"].bytes == 4 and got["dog/c.png"].label == "dog"
    import hashlib
    assert got["dog/c.png"].sha256 == hashlib.sha256(b"xy").hexdigest()


def test_versioned_state_and_upsert(spark, tmp_path):
    root = str(tmp_path / "state")
    cols = "case_id string, case_fingerprint string, state string, updated_seq long"
    v1 = spark.createDataFrame([("a", "fa", "received", 1), ("b", "fb", "received", 1)], cols)
    assert sstate.write_state(spark, v1, root) == 1
    up = spark.createDataFrame([("a", "fa", "pending_approval", 2), ("b", "XX", "failed", 2),
                                ("c", "fc", "received", 2), ("c", "fc", "failed", 3)], cols)
    new, refused = sstate.upsert_state(sstate.read_state(spark, root), up)
    assert sstate.write_state(spark, new, root) == 2
    cur = {r.case_id: r.state for r in sstate.read_state(spark, root).collect()}
    assert cur == {"a": "pending_approval", "b": "received", "c": "failed"}
    assert [r.case_id for r in refused.collect()] == ["b"]
    assert {r.case_id for r in sstate.read_state(spark, root, version=1).collect()} == {"a", "b"}


def test_export_approved_idempotent(spark):
    ap = spark.createDataFrame([("c1", "k1"), ("c2", "k2"), ("c3", "k3")], "case_id string, idempotency_key string")
    import hashlib
    slug = lambda c: hashlib.sha256(c.encode()).hexdigest()[:20]
    ex = spark.createDataFrame([(slug("c1"), "k1"), (slug("c2"), "other")], "slug string, idempotency_key string")
    got = {r.case_id: (r.status, r.receipt) for r in sstate.export_approved(ap, ex).collect()}
    assert got["c1"] == ("existing", f"file:handoff/approved-{slug('c1')}.json")
    assert got["c2"] == ("conflict", None) and got["c3"][0] == "export"


def test_text_log_and_report_sink(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "train.txt").write_text("start\n{'loss': 0.5, 'step': 1}\nnoise\n{'loss': 0.25, 'step': 2}\n")
    rows = [(r.line_no, r.loss) for r in sio.read_text_log(spark, str(tmp_path / "log")).orderBy("line_no").collect()]
    assert rows == [(2, 0.5), (4, 0.25)]
    rep = spark.createDataFrame([("r1", "a"), ("r2", "b")], "repository_id string, text string")
    sio.write_report(rep, str(tmp_path / "reports"))
    assert sorted(p.name for p in (tmp_path / "reports").iterdir() if p.name.startswith("repository_id=")) == [
        "repository_id=r1", "repository_id=r2"]


def test_duration_wording(spark):
    df = spark.createDataFrame([("e", "a", 50.0), ("e", "b", 1500.0), ("e", "c", None)],
                               "engagement_id string, repository_id string, provider_duration_ms double")
    df = df.selectExpr("*", "'low' risk", "0L observations", "0L to_review", "0L passed", "'' severity_counts", "'' scanners",
                       "true all_isolated", "0L citation_count", "false audit_verified")
    got = {r.repository_id: r.summary_md for r in report.management_summary(df).collect()}
    assert "| triage, s | 0.1 |" in got["a"] and "| triage, s | 1.5 |" in got["b"] and "| triage, s | - |" in got["c"]
    assert "| audit chain intact | no |" in got["a"]


def _files(root):
    import pathlib
    return {str(p) for p in pathlib.Path(root).rglob("*.parquet")}


def test_commits_refuse_a_second_writer_and_keep_old_files(spark, tmp_path):
    """Of two writers on one version the second is refused, also one that had checked before the first
    committed; 1 % of the cases rewrites no file."""
    import pytest
    root = str(tmp_path / "commits")
    cases = spark.range(1000).selectExpr(
        "concat('c', id) as case_id", "concat('f', id) as case_fingerprint", "'received' as state", "id as updated_seq")
    assert sstate.read_commits(spark, root) is None and sstate.committed_version(spark, root) == 0
    version, refused = sstate.commit_updates(spark, root, cases, 0)
    assert version == 1 and refused.count() == 0
    before = _files(root)
    some = cases.where("updated_seq % 100 = 0").withColumn("state", F.lit("approved")).withColumn("updated_seq", F.lit(5000).cast("long"))
    other = some.withColumn("state", F.lit("failed")).withColumn("case_fingerprint", F.lit("x"))
    assert sstate.commit_updates(spark, root, some, 1)[0] == 2
    with pytest.raises(sstate.StateConflict):
        sstate.commit_updates(spark, root, other, 1)
    with pytest.raises(sstate.StateConflict):
        sstate._publish(spark, root, 2, ["data/late"])
    version, refused = sstate.commit_updates(spark, root, other, 2)
    assert version == 3 and refused.count() == 10                       # other fingerprints
    assert before <= _files(root)
    states = lambda v: {r.state: r["count"] for r in sstate.read_commits(spark, root, v).groupBy("state").count().collect()}
    assert states(1) == {"received": 1000} and states(2) == states(3) == {"received": 990, "approved": 10}
    assert sstate.compact(spark, root, 3) == 4 and states(None) == states(3) and len(sstate._folders(spark, root, 4)) == 1


def test_small_files_are_written_by_several_tasks(spark, tmp_path):
    from claimtrail.sources import io
    reports = spark.range(64).coalesce(1).selectExpr("concat('r', id) AS repository_id", "cast(id AS string) AS text")
    io.write_report(reports, str(tmp_path / "reports"))
    files = list((tmp_path / "reports").glob("repository_id=r*/part-*.txt"))
    assert len(files) == 64 and len({f.name.split("-")[1] for f in files}) > 4
    # a merge by bytes after the grouping must not bring them back into one task
    grouped = io.spread(spark.range(640).selectExpr("id % 64 AS k", "id"), "k").groupBy("k").count()
    grouped.selectExpr("k", "cast(count AS string) AS value").write.partitionBy("k").text(str(tmp_path / "grouped"))
    assert len({f.name.split("-")[1] for f in (tmp_path / "grouped").glob("k=*/part-*.txt")}) > 4


def test_small_files_keep_their_lines_without_a_rank(spark, tmp_path, monkeypatch):
    """Every line end, byte order marks, bytes that are no UTF-8, null and blank lines: the same lines in one pass, by the
    rank of large files, and by a plain model; small files are not ranked."""
    import gzip
    import re
    from claimtrail.sources import io
    data = {"lf": b"a\nb\n\nc", "crlf": b"a\r\n\r\nb\r\n", "cr": b"a\rb\r", "mixed": b"\n\r\n\r\ra\n\n", "bom": b"\xef\xbb\xbfa\n\xef\xbb\xbfb\n",
            "only": b"\xef\xbb\xbf", "line": b"\xef\xbb\xbf\n", "bytes": b"\xff\xfe\x80a\n\xc3\n\xe2\x82\xac\x00\n", "empty": b""}
    model = {}
    for name, raw in data.items():
        (tmp_path / f"{name}.txt").write_bytes(raw)
        text = raw.removeprefix(io.BOM).decode("latin-1")
        lines = re.split("\r\n|\r|\n", text)
        model |= {(f"{name}.txt", n): x for n, x in enumerate(lines if lines[-1] else lines[:-1], 1)}

    def found():
        rows = io.read_lines(spark, str(tmp_path)).selectExpr("file", "line_no", "decode(cast(line AS binary), 'ISO-8859-1') AS line").collect()
        assert len({(r.file, r.line_no) for r in rows}) == len(rows)
        return {(r.file.rsplit("/", 1)[-1], r.line_no): r.line for r in rows}

    with monkeypatch.context() as m:
        m.setattr(io, "global_rank", None)
        assert found() == model
        assert "Exchange" not in io.read_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    long = "".join(f"line {i}\n" for i in range(3000))                   # larger than the bound, and one that unpacks to more
    (tmp_path / "long.txt").write_text(long)
    (tmp_path / "packed.txt.gz").write_bytes(gzip.compress(b"x\ny\n"))
    monkeypatch.setattr(io, "SMALL_FILE", 20_000)
    model |= {("long.txt", i + 1): f"line {i}" for i in range(3000)} | {("packed.txt.gz", 1): "x", ("packed.txt.gz", 2): "y"}
    assert found() == model
    monkeypatch.setattr(io, "SMALL_FILE", 0)
    assert found() == model


def test_text_files_one_for_each_key(spark, tmp_path, monkeypatch):
    """Files of several folders and batches, null and odd keys, null lines; a task that fails once leaves nothing that is read."""
    import os
    import pathlib
    from claimtrail.sources import io
    monkeypatch.setattr(io, "FOLDER_FILES", 3)
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 40 = 39 THEN null WHEN id % 40 = 38 THEN 'a/b=%' ELSE cast(id % 40 AS string) END AS k",
                                          "id", "CASE WHEN id % 7 <> 0 THEN concat('é', id) END AS line")
    io.write_text_files(io.spread(rows, "k").sortWithinPartitions("k", "id"), str(tmp_path / "logs"), "k", "line")
    files = {p.name: p for p in (tmp_path / "logs").rglob("*.txt")}
    assert len(files) == 40 == len(list((tmp_path / "logs").glob("part=*/k=*.txt"))) and {"k=__HIVE_DEFAULT_PARTITION__.txt", "k=a%2Fb%3D%25.txt"} <= set(files)
    assert max(len(os.listdir(d)) for d in (tmp_path / "logs").glob("part=*")) == 3 and not list((tmp_path / "logs").glob("_attempt*"))
    for k in range(38):
        want = [f"é{i}" if i % 7 else "" for i in range(k, 30_000, 40)]
        assert files[f"k={k}.txt"].read_text().split("\n") == want + [""]
    assert io.read_lines(spark, str(tmp_path / "logs")).count() == 30_000
    io.write_text_files(io.spread(rows.where("id < 0"), "k"), str(tmp_path / "none"), "k", "line")
    assert io.read_lines(spark, str(tmp_path / "none")).count() == 0
    folder = pathlib.Path(tmp_path / "twice")
    (folder / "_attempt-0-99-0").mkdir(parents=True)                      # of a task that was lost
    (folder / "_attempt-0-99-0" / "k=1.txt").write_text("half")
    io.write_text_files(io.spread(rows.where("k = '1'"), "k"), str(folder), "k", "line")
    assert io.read_lines(spark, str(folder)).count() == 750
