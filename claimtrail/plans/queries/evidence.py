"""Registered queries, group D (evidence): D1_normalize_sarif, D2_tool_slug, D3_map_severity, D4_result_limit, D5_control_presence, D6_merge_reports, D7_select_evidence, D7_select_evidence_chars, D8_selection_summary, D9_build_cases, D10_rule_scan, D11_scan_status."""

from ._shared import *  # noqa: F401,F403
from ._shared import register  # noqa: F401


@register("D1_normalize_sarif", f"""
WITH li AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus) AS run_index,
                 row_number() OVER (PARTITION BY l_orderkey, l_linestatus
                                    ORDER BY l_linenumber, l_partkey, l_suppkey) AS result_index,
                 'Scan Tool/' || l_linestatus || ' #' || CAST(l_orderkey % 3 AS VARCHAR) AS tool,
                 CASE WHEN l_tax > 0 THEN 'R' || CAST(l_suppkey AS VARCHAR) ELSE 'unclassified' END AS rule
            FROM lineitem)
SELECT l_orderkey AS doc_id, 'eng-1' AS engagement_id, 'repo-' || CAST(l_orderkey % 10 AS VARCHAR) AS repository_id,
       run_index, result_index,
       'sarif:' || {O.slug('tool')} || ':' || CAST(run_index AS VARCHAR) || ':' || CAST(result_index AS VARCHAR)
         || ':' || rule AS observation_id,
       'sarif:' || tool || ':' || rule AS "check", 'review' AS status,
       CASE WHEN l_returnflag = 'A' THEN 'high' WHEN l_returnflag = 'N' THEN 'medium'
            WHEN l_discount >= 0.02::DOUBLE THEN 'low' ELSE 'medium' END AS severity,
       CASE WHEN l_tax >= 0.02::DOUBLE THEN 'src/' || CAST(l_partkey AS VARCHAR) || '.py' ELSE 'unknown' END AS path,
       CASE WHEN l_discount < 0.09::DOUBLE THEN 'qty ' || CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR)
            ELSE 'No message' END AS message
FROM li
""")
def q_d1(spark, sf_dir):
    obs = evidence.normalize_sarif(fixtures.sarif_documents(spark, sf_dir))
    return obs.select("doc_id", "engagement_id", "repository_id",
                      F.col("run_index").cast("bigint").alias("run_index"),
                      F.col("result_index").cast("bigint").alias("result_index"),
                      "observation_id", "check", "status", "severity", "path", "message")


@register("D2_tool_slug", f"""
SELECT p_partkey, {O.slug("p_name || ' #' || p_brand || '/' || p_type")} AS slug FROM part
""")
def q_d2(spark, sf_dir):
    part = fixtures.table(spark, sf_dir, "part")
    return part.select("p_partkey", evidence.tool_slug(
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_brand"), F.lit("/"), F.col("p_type"))).alias("slug"))


@register("D3_map_severity", f"""
SELECT event_id, CASE {_EVENT_LEVEL} WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium'
                      WHEN 'note' THEN 'low' WHEN 'none' THEN 'info' ELSE 'medium' END AS severity
FROM events
""")
def q_d3(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events")
    return ev.select("event_id", evidence.map_severity(F.expr(_EVENT_LEVEL)).alias("severity"))


@register("D4_result_limit", """
SELECT l_orderkey AS doc_id, count(*) AS n_results,
       'SARIF report exceeds the configured result limit' AS reason
FROM lineitem GROUP BY l_orderkey HAVING count(*) > 5
""")
def q_d4(spark, sf_dir):
    obs = evidence.normalize_sarif(fixtures.sarif_documents(spark, sf_dir))
    _, rejected = evidence.result_limit(obs, max_results=5)
    return rejected.select("doc_id", F.col("n_results").cast("bigint").alias("n_results"), "reason")


@register("D5_control_presence", """
WITH files AS (SELECT DISTINCT 'cust-' || CAST(o_custkey AS VARCHAR) AS repository_id, o_orderpriority AS path
               FROM orders),
  repos AS (SELECT DISTINCT repository_id FROM files),
  ctl AS (SELECT * FROM (VALUES (0, 'urgent', ['1-URGENT', '2-HIGH'], 'high'),
                                (1, 'medium', ['3-MEDIUM'], 'medium'),
                                (2, 'routine', ['4-NOT SPECIFIED', '5-LOW'], 'low')) t(ctl_pos, chk, cands, sev)),
  cand AS (SELECT ctl_pos, chk, cands, sev, unnest(cands) AS cand, generate_subscripts(cands, 1) AS prio FROM ctl),
  found AS (SELECT r.repository_id, c.ctl_pos, arg_min(c.cand, c.prio) AS found
            FROM repos r JOIN cand c ON TRUE JOIN files f ON f.repository_id = r.repository_id AND f.path = c.cand
            GROUP BY r.repository_id, c.ctl_pos)
SELECT 'eng-1' AS engagement_id, r.repository_id, CAST(c.ctl_pos AS BIGINT) AS pos,
       'repo-policy:' || c.chk AS observation_id, c.chk AS "check",
       CASE WHEN f.found IS NOT NULL THEN 'pass' ELSE 'review' END AS status,
       CASE WHEN f.found IS NOT NULL THEN 'info' ELSE c.sev END AS severity,
       coalesce(f.found, c.cands[1]) AS path,
       CASE WHEN f.found IS NOT NULL THEN 'Control is visible at ' || f.found || '.'
            ELSE 'No ' || c.chk || ' control was found at the checked standard locations.' END AS message
FROM repos r JOIN ctl c ON TRUE LEFT JOIN found f ON f.repository_id = r.repository_id AND f.ctl_pos = c.ctl_pos
""")
def q_d5(spark, sf_dir):
    repos, files = fixtures.repository_files(spark, sf_dir)
    return evidence.control_presence(repos, files, fixtures.PRIORITY_CONTROLS)


@register("D6_merge_reports", f"""
WITH {O.OBS},
  exp AS (SELECT 'repo-' || CAST(s_suppkey AS VARCHAR) AS merge_id, 'eng-1' AS e,
                 CASE WHEN s_nationkey = 3 THEN 'repo-x' ELSE 'repo-' || CAST(s_suppkey AS VARCHAR) END AS r
          FROM supplier),
  j AS (SELECT exp.merge_id, max(CASE WHEN obs.engagement_id <> exp.e THEN 1 ELSE 0 END) AS be,
               max(CASE WHEN obs.repository_id <> exp.r THEN 1 ELSE 0 END) AS br, count(*) AS n
        FROM obs JOIN exp ON obs.repository_id = exp.merge_id GROUP BY exp.merge_id)
SELECT exp.merge_id,
       CASE WHEN coalesce(j.be, 0) = 1 OR coalesce(j.br, 0) = 1 THEN 0 ELSE coalesce(j.n, 0) END AS n_merged,
       CASE WHEN j.be = 1 THEN 'cannot merge reports from different engagements'
            WHEN j.br = 1 THEN 'cannot merge reports from different repositories' END AS reason
FROM exp LEFT JOIN j USING (merge_id)
""")
def q_d6(spark, sf_dir):
    obs = fixtures.observations(spark, sf_dir).withColumn("merge_id", F.col("repository_id"))
    part_a = obs.where(F.col("check") == "flag-A")
    part_b = obs.where(F.col("check") != "flag-A")
    sup = fixtures.table(spark, sf_dir, "supplier")
    expected = sup.select(
        F.concat(F.lit("repo-"), F.col("s_suppkey").cast("string")).alias("merge_id"),
        F.lit("eng-1").alias("engagement_id"),
        F.when(F.col("s_nationkey") == 3, F.lit("repo-x")).otherwise(
            F.concat(F.lit("repo-"), F.col("s_suppkey").cast("string"))).alias("repository_id"))
    merged, refused = evidence.merge_reports([part_a, part_b], expected)
    counts = merged.groupBy("merge_id").agg(F.count(F.lit(1)).alias("n_merged"))
    return (expected.select("merge_id").join(counts, "merge_id", "left").join(refused, "merge_id", "left")
            .select("merge_id", F.coalesce("n_merged", F.lit(0)).cast("bigint").alias("n_merged"), "reason"))


@register("D7_select_evidence", f"""
WITH {O.OBS}, {O.selected()}
SELECT engagement_id, repository_id, observation_id, rn - 1 AS sel_pos, text FROM sel
""")
def q_d7(spark, sf_dir):
    sel = evidence.select_evidence(fixtures.observations(spark, sf_dir))
    return sel.select("engagement_id", "repository_id", "observation_id", "sel_pos", "text")


@register("D7_select_evidence_chars", f"""
WITH {O.OBS}, {O.selected(100, 5000)}
SELECT engagement_id, repository_id, observation_id, rn - 1 AS sel_pos FROM sel
""")
def q_d7c(spark, sf_dir):
    sel = evidence.select_evidence(fixtures.observations(spark, sf_dir), max_items=100, max_chars=5000)
    return sel.select("engagement_id", "repository_id", "observation_id", "sel_pos")


@register("D8_selection_summary", f"""
WITH {O.OBS}, {O.REPORTS}, {O.selected()}, {_SUMMARY_SQL}
SELECT engagement_id, repository_id, source_id, text, sel_pos FROM summ WHERE source_id IS NOT NULL
""")
def q_d8(spark, sf_dir):
    obs = fixtures.observations(spark, sf_dir, materialize=True)
    sel = evidence.select_evidence(obs)
    return evidence.selection_summary(fixtures.reports(spark, sf_dir), obs, sel)


@register("D9_build_cases", f"""
WITH {O.OBS}, {O.REPORTS}, {O.selected()}, {_SUMMARY_SQL},
  leaf AS (SELECT engagement_id, repository_id, pos,
                  sha256({O.canon('observation_id')} || {O.canon('"check"')} || {O.canon('status')}
                         || {O.canon('severity')} || {O.canon('path')} || {O.canon('message')}) AS leaf
           FROM obs),
  {O.merkle('leaf', 'engagement_id, repository_id', 'pos', 'leaf')},
  hdr AS (SELECT r.engagement_id, r.repository_id,
                 r.engagement_id || ':' || r.repository_id || ':' ||
                 substring(coalesce(sha256({O.canon('r.engagement_id')} || {O.canon('r.repository_id')} || mtop.tree),
                                    sha256({O.canon('r.engagement_id')} || {O.canon('r.repository_id')})), 1, 16) AS case_id,
                 'Assurance observations for ' || r.repository_id AS title
          FROM reports r LEFT JOIN mtop USING (engagement_id, repository_id)),
  src AS (SELECT engagement_id, repository_id, rn - 1 AS pos, observation_id AS source_id, text FROM sel
          UNION ALL SELECT engagement_id, repository_id, sel_pos, source_id, text FROM summ WHERE source_id IS NOT NULL)
SELECT hdr.case_id, hdr.title, count(*) AS n_sources, CAST(sum(length(src.text)) AS BIGINT) AS total_chars,
       arg_max(src.source_id, src.pos) AS last_source_id
FROM hdr JOIN src USING (engagement_id, repository_id)
GROUP BY hdr.case_id, hdr.title
""")
def q_d9(spark, sf_dir):
    headers, sources = evidence.build_cases(fixtures.reports(spark, sf_dir), fixtures.observations(spark, sf_dir, materialize=True))
    agg = sources.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_sources"), F.sum(F.length("text")).cast("bigint").alias("total_chars"),
        F.max_by("source_id", "pos").alias("last_source_id"))
    return headers.select("case_id", "title").join(agg, "case_id")


@register("D10_rule_scan", _rule_scan_sql())
def q_d10(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    hits = evidence.rule_scan(docs, TEXT_RULES)
    return hits.select("text_id", "rule_id", "observation_id", "severity", "match_index", "match_length")


@register("D10_rule_table", """
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark),
  r AS (SELECT w FROM w WHERE regexp_matches(w, '^[a-z]{8,}$')),
  m AS (SELECT doc_id, w, regexp_extract_all(text, w || '[a-z]*') AS m FROM documents JOIN r ON contains(text, w)),
  u AS (SELECT doc_id, w, unnest(m) AS mt, generate_subscripts(m, 1) AS idx FROM m)
SELECT doc_id AS text_id, 'word-' || w AS rule_id, 'rule:word-' || w || ':' || CAST(doc_id AS VARCHAR) || ':' || CAST(idx AS VARCHAR) AS observation_id,
       CAST(idx AS BIGINT) AS match_index, CAST(length(mt) AS BIGINT) AS match_length
FROM u
""")
def q_d10t(spark, sf_dir):
    """A rule for each long word of the benchmark texts, given as a table."""
    docs = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    hits = evidence.rule_table_scan(docs, fixtures.word_rules(spark, sf_dir))
    return hits.select("text_id", "rule_id", "observation_id", "match_index", "match_length")


_REDACTED = "text"
for _rule in TEXT_RULES:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_rule[1]}', '[REDACTED]', 'g')"


@register("D10_redact", f"""
SELECT doc_id, sha256({_REDACTED}) AS redacted_sha256, {_REDACTED} <> text AS changed FROM documents
""")
def q_d10r(spark, sf_dir):
    """Whole texts with every match of the rules taken out."""
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text", evidence.redact("text", TEXT_RULES).alias("redacted"))
    return docs.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), (F.col("redacted") != F.col("text")).alias("changed"))


@register("D11_scan_status", f"""
WITH e AS (SELECT event_id, {_SCANNER} AS scanner, user_id % 3 AS rc, value >= 5 AS present FROM events)
SELECT event_id, scanner, CAST(rc AS BIGINT) AS return_code,
       CASE WHEN NOT (rc = 0 OR (rc = 1 AND scanner IN ('gitleaks', 'osv'))) THEN 'error'
            WHEN NOT present THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN NOT (rc = 0 OR (rc = 1 AND scanner IN ('gitleaks', 'osv')))
              THEN scanner || ' failed with exit code ' || CAST(rc AS VARCHAR)
            WHEN NOT present THEN scanner || ' did not produce a SARIF report' END AS reason
FROM e
""")
def q_d11(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events")
    ex = ev.select("event_id", F.expr(_SCANNER).alias("scanner"),
                   (F.col("user_id") % 3).cast("bigint").alias("return_code"),
                   (F.col("value") >= 5).alias("output_present"))
    return evidence.scan_status(ex).select("event_id", "scanner", "return_code", "status", "reason")
