"""Registered queries, group A (sources): A1_read_cases, A2_read_sarif, A3_read_scope, A4_read_audit, A5_read_predictions, A5_read_measurements, A6_file_manifest, A7_read_train_log, A9_upsert_state, A10_export_approved, A8_write_report."""

from ._shared import *  # noqa: F401,F403
from ._shared import register  # noqa: F401


@register("A1_read_cases", f"""
WITH {O.CONV_SOURCES}, {O.e1_reason()}
SELECT case_id, reason FROM e1
""")
def q_a1(spark, sf_dir):
    """Conversation cases written as case JSON lines, read back, validated."""
    conv = fixtures.table(spark, sf_dir, "conversations")
    nested = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.col("turn").cast("string").alias("source_id"), "text"))).alias("_s"))
    cases = nested.select(F.col("conv_id").cast("string").alias("case_id"),
                          F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"),
                          F.transform("_s", lambda e: F.struct(e["source_id"].alias("source_id"),
                                                               e["text"].alias("text"))).alias("sources"))
    path = scratch_path(spark, "cases")
    cases.write.json(path)
    headers, sources = sio.explode_cases(sio.read_cases(spark, path))
    return validate.validate_cases(headers, sources)


@register("A2_read_sarif", """
SELECT 'repo-' || CAST(l_orderkey // 500 AS VARCHAR) AS repository_id, count(*) AS n_results,
       count(DISTINCT (l_orderkey, l_linestatus)) AS n_runs, CAST(NULL AS VARCHAR) AS reason
FROM lineitem GROUP BY 1
""")
def q_a2(spark, sf_dir):
    """SARIF documents (one file for 500 orders, so a file has a bounded size
    and their number grows with the table) written, read with a 1 MB cap,
    normalized, counted; a rejected file is a row with its reason."""
    docs = fixtures.sarif_documents(spark, sf_dir).withColumn(
        "_file", F.concat(F.lit("repo-"), F.floor(F.col("doc_id") / 500).cast("string")))
    runs = docs.select("_file", "doc_id", F.explode("sarif.runs").alias("run"))
    per_file = sio.spread(runs, "_file").groupBy("_file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "run"))), lambda e: e["run"]).alias("runs"))
    path = scratch_path(spark, "sarif")
    (per_file.select("_file", F.to_json(F.struct(F.lit("2.1.0").alias("version"), "runs")).alias("value"))
     .withColumnRenamed("_file", "repository_id").write.partitionBy("repository_id").text(path))
    ok, rejected = sio.read_sarif(spark, path, max_bytes=1_000_000, glob="*.txt")
    name = lambda c: F.regexp_extract(c, r"repository_id=([^/]+)", 1).alias("repository_id")
    obs = evidence.normalize_sarif(ok.select(name("doc_id"), "doc_id", "sarif", F.lit("eng-1").alias("engagement_id")))
    counted = obs.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.count_distinct("doc_id", "run_index").alias("n_runs"),
        F.lit(None).cast("string").alias("reason"))
    return counted.unionByName(rejected.select(
        name("path"), F.lit(None).cast("bigint").alias("n_results"), F.lit(None).cast("bigint").alias("n_runs"), "reason"))


@register("A3_read_scope", f"""
WITH {_SCOPES_SQL},
  st AS (SELECT engagement_id, count(*) AS n, count(DISTINCT repository_id) AS nd,
                max(CASE WHEN regexp_full_match(repository_id, '[A-Za-z0-9._-]+') THEN 0 ELSE 1 END) AS bad
         FROM sr GROUP BY engagement_id)
SELECT engagement_id,
       CASE WHEN version <> 1 THEN 'scope version must be 1'
            WHEN egress NOT IN ('deny', 'local-only', 'allow') THEN 'egress must be deny, local-only, or allow'
            WHEN coalesce(n, 0) = 0 THEN 'scope must authorize at least one repository'
            WHEN bad = 1 THEN 'repository_id contains unsupported characters'
            WHEN nd <> n THEN 'repository_id values must be unique' END AS reason
FROM sc LEFT JOIN st USING (engagement_id)
""")
def q_a3(spark, sf_dir):
    """Scope manifests (one JSON file per nation) written, read, validated."""
    sc, repos = fixtures.scopes(spark, sf_dir)
    nested = repos.groupBy("engagement_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "pos", "repository_id", "path", "allowed_checks"))), lambda e: F.struct(
        e["repository_id"].alias("repository_id"), e["path"].alias("path"),
        e["allowed_checks"].alias("allowed_checks"))).alias("repositories"))
    doc = sc.join(nested, "engagement_id", "left").select(
        F.col("engagement_id").alias("part"),
        F.to_json(F.struct(F.col("version").cast("long").alias("version"), "engagement_id", "customer",
                           F.col("expires_on").cast("string").alias("expires_on"), "egress", "repositories"))
        .alias("value"))
    path = scratch_path(spark, "scope")
    doc.write.partitionBy("part").text(path)
    scopes, scope_repos = sio.read_scope(spark, path)
    return scope.validate_scope(scopes, scope_repos)


@register("A4_read_audit", """
SELECT user_id AS chain, true AS valid, CAST(NULL AS BIGINT) AS first_bad_seq, count(*) AS n
FROM events GROUP BY user_id
""")
def q_a4(spark, sf_dir):
    """Hashed audit rows appended as JSON lines (A8), read back (A4),
    verified (B4)."""
    audit = chainops.chain_append(fixtures.audit_events(spark, sf_dir))
    path = scratch_path(spark, "audit")
    sio.write_audit(audit, path)
    back = sio.read_audit(spark, path)
    return chainops.chain_verify(back).select("chain", "valid", "first_bad_seq", F.col("n").cast("bigint").alias("n"))


@register("A5_read_predictions", f"""
WITH {_f3_sql(0)}
SELECT count(*) AS n, avg(CAST(correct AS DOUBLE)) AS accuracy, round(avg(confidence), 6) AS mean_confidence,
       avg(CAST(free_top_is_letter AS DOUBLE)) AS letter_rate FROM preds
""")
def q_a5(spark, sf_dir):
    """Prediction JSON lines written and read with the prediction schema."""
    p = fixtures.predictions(spark, sf_dir).select(
        F.col("key").cast("string").alias("path"), "label", "pred", "confidence", "correct", "free_top_is_letter")
    path = scratch_path(spark, "predictions")
    p.write.json(path)
    return evaluate.accuracy(sio.read_predictions(spark, path)).withColumn(
        "mean_confidence", F.round("mean_confidence", 6))


@register("A5_read_measurements", f"""
WITH {_MEAS_SQL},
  r AS (SELECT rel_pct, row_number() OVER (ORDER BY rel_pct, image) AS rn, count(*) OVER () AS n FROM errs),
  s AS (SELECT max(n) AS n, quantile_cont(rel_pct, 0.5) AS median_pct,
               max(CASE WHEN rn = least(n - 1, CAST(floor(0.95::DOUBLE * n) AS BIGINT)) + 1 THEN rel_pct END) AS p95_pct
        FROM r)
SELECT n, round(median_pct, 6) AS median_pct, round(p95_pct, 6) AS p95_pct,
       CASE WHEN median_pct <= 2.0 AND p95_pct <= 4.0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s
""")
def q_a5m(spark, sf_dir):
    """Measurement and truth CSV files written, read back, summarized."""
    res = fixtures.measurement_results(spark, sf_dir).select(
        "image", F.lit("(0, 0)").alias("px1"), F.lit("(0, 0)").alias("px2"), "measured_mm")
    tr = fixtures.measurement_truth(spark, sf_dir)
    p1, p2 = scratch_path(spark, "results"), scratch_path(spark, "truth")
    res.write.option("header", True).csv(p1)
    tr.orderBy("truth_pos").select("object", "true_mm").write.option("header", True).csv(p2)
    errs = measure.measurement_errors(sio.read_measurements(spark, p1), sio.read_truth(spark, p2))
    return _round_summary(measure.error_summary(errs))


@register("A6_file_manifest", """
SELECT 'lang=' || lang AS label, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang
""")
def q_a6(spark, sf_dir):
    """Document texts written as files per language; the manifest hashes and
    measures every file; bytes summed per label."""
    d = fixtures.table(spark, sf_dir, "documents")
    path = scratch_path(spark, "files")
    d.select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    m = sio.file_manifest(spark, path, extensions=(".txt",))
    return m.groupBy("label").agg(F.sum("bytes").cast("bigint").alias("bytes"))


@register("A7_read_train_log", """
SELECT user_id AS run, count(*) AS steps, max(event_id) AS last_step, arg_max(value / 100, event_id) AS last_loss,
       round(avg(value / 100), 6) AS mean_loss, min(value / 100) AS min_loss
FROM events GROUP BY user_id
""")
def q_a7(spark, sf_dir):
    """One trainer-state JSON per user written, read (log_history exploded),
    summarized per run."""
    ev = fixtures.table(spark, sf_dir, "events")
    hist = sio.spread(ev.select("user_id", "event_id", "value"), "user_id").groupBy("user_id").agg(F.max("event_id").alias("global_step"), F.transform(F.array_sort(
        F.collect_list(F.struct(F.col("event_id").alias("step"), (F.col("value") / 100).alias("loss")))),
        lambda e: F.struct(F.lit(1.0).alias("epoch"), F.lit(None).cast("double").alias("grad_norm"),
                           F.lit(0.0002).alias("learning_rate"), e["loss"].alias("loss"),
                           e["step"].alias("step"))).alias("log_history"))
    path = scratch_path(spark, "trainlog")
    hist.select(F.col("user_id").alias("run"), F.to_json(F.struct("global_step", "log_history")).alias("value")) \
        .write.partitionBy("run").text(path)
    log = sio.read_train_log(spark, path).withColumn(
        "run", F.regexp_extract("run", r"run=([0-9]+)", 1).cast("bigint"))
    return evaluate.train_curve(log).withColumn("mean_loss", F.round("mean_loss", 6))


@register("A4_foreign_audit", """
SELECT conv_id, conv_id % 7 <> 3 AND conv_id % 11 <> 5 AS valid,
       CASE WHEN conv_id % 7 = 3 THEN 1 WHEN conv_id % 11 = 5 THEN count(*) + 1 END AS first_bad_line,
       count(*) + CASE WHEN conv_id % 11 = 5 THEN 1 ELSE 0 END AS n
FROM conversations GROUP BY conv_id
""")
def q_a4f(spark, sf_dir):
    """Audit files of another system, one for each conversation: read line by line
    (A4), canonical JSON with nesting and escapes (B6), links verified (B4)."""
    path = scratch_path(spark, "foreign")
    lines = fixtures.foreign_audit_lines(spark, sf_dir).withColumn("conv", F.col("conv_id"))
    sio.spread(lines, "conv").sortWithinPartitions("conv", "pos").select("conv", "value").write.partitionBy("conv").text(path)
    found = chainops.foreign_chain_verify(sio.read_lines(spark, path))
    return found.select(F.regexp_extract("file", r"conv=(-?[0-9]+)/", 1).cast("bigint").alias("conv_id"), "valid", "first_bad_line", "n")


@register("A6_content_hash", """
SELECT 'item=' || CAST(item_id AS VARCHAR) AS label, CAST(strlen(text) + 1 AS BIGINT) AS bytes, sha256(text || chr(10)) AS sha256 FROM benchmark
""")
def q_a6h(spark, sf_dir):
    """One file for each benchmark text: the manifest's sizes and content hashes."""
    path = scratch_path(spark, "items")
    b = fixtures.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("value"))
    b.write.partitionBy("item").text(path)
    found = sio.file_manifest(spark, path, extensions=(".txt",))
    return found.where(F.col("path").startswith(F.concat("label", F.lit("/")))).select("label", "bytes", "sha256")


@register("A7_text_log", """
SELECT user_id AS run, count(*) AS n, round(sum(value / 100), 6) AS loss, max(rn) * 2 AS last_line
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY user_id
""")
def q_a7t(spark, sf_dir):
    """Text logs, one for each user: progress lines and dictionaries with the loss."""
    path = scratch_path(spark, "logs")
    ev = fixtures.table(spark, sf_dir, "events")
    rows = sio.spread(ev.select(F.col("user_id").alias("run"), "event_id", "value"), "run")
    lines = rows.select("run", "event_id", F.explode(F.array(
        F.struct(F.lit(0).alias("i"), F.concat(F.col("event_id").cast("string"), F.lit("%|##| 'loss pending'")).alias("value")),
        F.struct(F.lit(1).alias("i"), F.concat(F.lit("{'loss': "), (F.col("value") / 100).cast("string"), F.lit(", 'epoch': 1}")).alias("value")))).alias("l"))
    sio.write_text_files(lines.sortWithinPartitions("run", "event_id", "l.i").select("run", "l.value"), path, "run", "value")
    log = sio.read_text_log(spark, path)
    run = F.regexp_extract("file", r"run=(-?[0-9]+)[/.]", 1).cast("bigint")
    return log.groupBy(run.alias("run")).agg(F.count("*").cast("bigint").alias("n"), F.round(F.sum("loss"), 6).alias("loss"),
                                             F.max("line_no").cast("bigint").alias("last_line"))


@register("A9_upsert_state", f"""
WITH {_SNAPSHOT},
  st AS (SELECT * FROM snap WHERE CAST(substring(case_id, 6) AS BIGINT) % 3 <> 0),
  up AS (SELECT case_id,
                CASE WHEN CAST(substring(case_id, 6) AS BIGINT) % 5 = 0 THEN sha256('other') ELSE case_fingerprint END
                  AS case_fingerprint, 'approved' AS state FROM snap WHERE CAST(substring(case_id, 6) AS BIGINT) % 2 = 0),
  j AS (SELECT coalesce(st.case_id, up.case_id) AS case_id, st.case_fingerprint AS ofp, st.state AS ost,
               up.case_fingerprint AS nfp, up.state AS nst FROM st FULL OUTER JOIN up ON st.case_id = up.case_id)
SELECT case_id,
       CASE WHEN nfp IS NOT NULL AND NOT coalesce(ofp <> nfp, false) THEN nfp ELSE ofp END AS case_fingerprint,
       CASE WHEN nfp IS NOT NULL AND NOT coalesce(ofp <> nfp, false) THEN nst ELSE ost END AS state,
       coalesce(ofp <> nfp, false) AS refused
FROM j
""")
def q_a9(spark, sf_dir):
    snap = fixtures.state_snapshot(spark, sf_dir)
    uid = F.substring("case_id", 6, 100).cast("bigint")
    st = snap.where(uid % 3 != 0)
    up = snap.where(uid % 2 == 0).withColumn(
        "case_fingerprint", F.when(uid % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("case_fingerprint"))
    ).withColumn("state", F.lit("approved"))
    root = scratch_path(spark, "state")         # through the table on disk: two versions
    sstate.write_state(spark, st, root)
    new_state, refused = sstate.upsert_state(sstate.read_state(spark, root), up)
    sstate.write_state(spark, new_state, root)
    new_state = sstate.read_state(spark, root)
    flag = refused.select("case_id", F.lit(True).alias("refused"))
    return new_state.join(flag, "case_id", "left").select(
        "case_id", "case_fingerprint", "state", F.coalesce("refused", F.lit(False)).alias("refused"))


@register("A9_commit_updates", f"""
WITH {_SNAPSHOT},
  s AS (SELECT *, CAST(substring(case_id, 6) AS BIGINT) AS uid FROM snap),
  first AS (SELECT * FROM s WHERE uid % 3 <> 0),
  one AS (SELECT coalesce(f.case_id, u.case_id) AS case_id,
                 CASE WHEN u.case_id IS NOT NULL AND NOT (f.case_id IS NOT NULL AND u.uid % 5 = 0) THEN 'approved' ELSE f.state END AS state,
                 CASE WHEN f.case_id IS NULL AND u.uid % 5 = 0 THEN sha256('other') ELSE coalesce(f.case_fingerprint, u.case_fingerprint) END AS fp
          FROM first f FULL OUTER JOIN (SELECT * FROM s WHERE uid % 2 = 0) u ON u.case_id = f.case_id),
  two AS (SELECT coalesce(o.case_id, u.case_id) AS case_id, coalesce(o.fp, u.case_fingerprint) AS fp,
                 CASE WHEN u.case_id IS NOT NULL AND NOT coalesce(o.fp <> u.case_fingerprint, false) THEN 'failed' ELSE o.state END AS state
          FROM one o FULL OUTER JOIN (SELECT * FROM s WHERE uid % 7 = 0) u ON u.case_id = o.case_id)
SELECT case_id, fp AS case_fingerprint, state, CAST(3 AS BIGINT) AS version, true AS second_writer_refused FROM two
""")
def q_a9c(spark, sf_dir):
    """Two writers judge their updates against version 1.  The first commits; the
    second is refused, reads version 2, judges again and commits version 3."""
    snap = fixtures.state_snapshot(spark, sf_dir)
    uid = F.substring("case_id", 6, 100).cast("bigint")
    mine = snap.where(uid % 2 == 0).withColumn("state", F.lit("approved")).withColumn(
        "case_fingerprint", F.when(uid % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("case_fingerprint")))
    theirs = snap.where(uid % 7 == 0).withColumn("state", F.lit("failed"))
    root = scratch_path(spark, "commits")
    base, _ = sstate.commit_updates(spark, root, snap.where(uid % 3 != 0), 0)
    sstate.commit_updates(spark, root, mine, base)
    try:
        version, refused = sstate.commit_updates(spark, root, theirs, base)[0], False
    except sstate.StateConflict:
        version, refused = sstate.commit_updates(spark, root, theirs, sstate.committed_version(spark, root))[0], True
    return sstate.read_commits(spark, root).select("case_id", "case_fingerprint", "state", F.lit(version).cast("bigint").alias("version"),
                                                   F.lit(refused).alias("second_writer_refused"))


@register("A10_export_approved", f"""
WITH {_SNAPSHOT},
  ap AS (SELECT case_id, risk, reviewer, case_fingerprint || ':' || assessment_fp AS k,
                substring(sha256(case_id), 1, 20) AS slug, CAST(substring(case_id, 6) AS BIGINT) AS uid
         FROM snap WHERE state IN ('approved', 'published')),
  ex AS (SELECT slug, CASE WHEN uid % 6 = 0 THEN 'other-key' ELSE k END AS ek FROM ap WHERE uid % 4 = 0 OR uid % 6 = 0),
  st AS (SELECT ap.*, CASE WHEN uid % 7 = 0 THEN 'refused' WHEN ex.ek IS NULL THEN 'export' WHEN ex.ek = ap.k THEN 'existing'
                           ELSE 'conflict' END AS status FROM ap LEFT JOIN ex USING (slug))
SELECT case_id, slug, k AS idempotency_key, status,
       CASE WHEN status IN ('export', 'existing') THEN 'file:handoff/approved-' || slug || '.json' END AS receipt,
       CASE WHEN status = 'export' THEN reviewer END AS exported_by, CASE WHEN status = 'export' THEN risk END AS exported_risk
FROM st
""")
def q_a10(spark, sf_dir):
    """Approved cases exported with their payload; the export table is written
    and read back (an earlier export of some keys, one of them conflicting)."""
    snap = fixtures.state_snapshot(spark, sf_dir).where(F.col("state").isin("approved", "published"))
    uid = F.substring("case_id", 6, 100).cast("bigint")
    ap = snap.select("case_id", F.when(uid % 7 != 0, F.col("reviewer")).alias("reviewer"), "risk",
                     hashing.idempotency_key("case_fingerprint", "assessment_fp").alias("idempotency_key"), uid.alias("uid"))
    root = scratch_path(spark, "exports")
    earlier = ap.where((F.col("uid") % 4 == 0) | (F.col("uid") % 6 == 0)).select(
        F.substring(F.sha2("case_id", 256), 1, 20).alias("slug"),
        F.when(F.col("uid") % 6 == 0, F.lit("other-key")).otherwise(F.col("idempotency_key")).alias("idempotency_key"),
        F.lit("{}").alias("payload"))
    sstate.write_exports(spark, earlier, root)
    decided = sstate.export_approved(ap, sstate.read_exports(spark, root))
    sstate.write_exports(spark, sstate.export_payloads(decided, ap.select("case_id", "reviewer", "risk")), root)
    back = sstate.read_exports(spark, root).where("payload <> '{}'").select(
        "slug", F.get_json_object("payload", "$.reviewer").alias("exported_by"),
        F.get_json_object("payload", "$.risk").alias("exported_risk"))
    return decided.join(back, "slug", "left").select(
        "case_id", "slug", "idempotency_key", "status", "receipt", "exported_by", "exported_risk")


@register("A8_write_report", f"""
WITH {O.OBS}, {O.REPORTS}, {O.selected()}, {_SUMMARY_SQL}, {_TRIAGE_SQL}, {_EXEC_SQL},
  tob AS (SELECT engagement_id, repository_id, count(*) AS observations FROM obs GROUP BY ALL),
  iso AS (SELECT engagement_id, repository_id, bool_and(iso) AS iso FROM ex GROUP BY ALL)
SELECT r.repository_id, coalesce(tob.observations, 0) AS observations, tri.risk, coalesce(iso.iso, true) AS all_isolated
FROM reports r LEFT JOIN tob USING (engagement_id, repository_id) LEFT JOIN tri ON tri.case_id = r.repository_id
     LEFT JOIN iso USING (engagement_id, repository_id)
""")
def q_a8(spark, sf_dir):
    """Per-repository metrics written as one JSON artifact per repository
    (partitioned text), read back with a schema."""
    m = _metrics(spark, sf_dir)
    path = scratch_path(spark, "reports")
    sio.write_report(m.select("repository_id", F.to_json(F.struct("observations", "risk", "all_isolated")).alias("text")),
                     path)
    back = spark.read.schema("observations long, risk string, all_isolated boolean").json(path)
    return back.select(F.col("repository_id").cast("string").alias("repository_id"), "observations", "risk",
                       "all_isolated")
