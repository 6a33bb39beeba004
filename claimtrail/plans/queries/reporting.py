"""Registered queries, group J (reporting): J1_pilot_metrics, J2_management_summary, J3_evidence_pack, J4_counters, J5_latency, J6_workflow_sli, J7_markdown_table."""

from ._shared import *  # noqa: F401,F403
from ._shared import register  # noqa: F401


_METRICS_SQL = f"""
  {O.OBS}, {O.REPORTS}, {O.selected()}, {_SUMMARY_SQL}, {_TRIAGE_SQL}, {_EXEC_SQL},
  tob AS (SELECT engagement_id, repository_id, count(*) AS n, count(*) FILTER (status = 'review') AS nr,
                 count(*) FILTER (status = 'pass') AS np FROM obs GROUP BY ALL),
  stc AS (SELECT engagement_id, repository_id, string_agg(status || '=' || CAST(n AS VARCHAR), ',' ORDER BY status) AS st
          FROM (SELECT engagement_id, repository_id, status, count(*) AS n FROM obs GROUP BY ALL) GROUP BY ALL),
  svc AS (SELECT engagement_id, repository_id, string_agg(severity || '=' || CAST(n AS VARCHAR), ',' ORDER BY severity) AS sv
          FROM (SELECT engagement_id, repository_id, severity, count(*) AS n FROM obs GROUP BY ALL) GROUP BY ALL),
  run AS (SELECT engagement_id, repository_id, bool_and(iso) AS iso, count(*) AS n_runs, max(ms) AS ms,
                 array_to_string(list_sort(list(DISTINCT scanner)), ',') AS scanners FROM ex GROUP BY ALL),
  leaf AS (SELECT engagement_id, repository_id, pos,
                  sha256({O.canon('observation_id')} || {O.canon('"check"')} || {O.canon('status')}
                         || {O.canon('severity')} || {O.canon('path')} || {O.canon('message')}) AS leaf
           FROM obs),
  {O.merkle('leaf', 'engagement_id, repository_id', 'pos', 'leaf')},
  met AS (SELECT r.engagement_id, r.repository_id,
       coalesce(sha256({O.canon('r.engagement_id')} || {O.canon('r.repository_id')} || mtop.tree),
                sha256({O.canon('r.engagement_id')} || {O.canon('r.repository_id')})) AS report_fingerprint,
       coalesce(n, 0) AS observations, coalesce(nr, 0) AS to_review, coalesce(np, 0) AS passed,
       coalesce(st, '') AS status_counts, coalesce(sv, '') AS severity_counts, tri.risk,
       CASE WHEN tri.risk IS NOT NULL THEN 1.0::DOUBLE END AS confidence, tri.n_citations AS citation_count,
       CASE WHEN tri.risk IS NOT NULL THEN 'deterministic-baseline,' || CASE WHEN tri.n_review > 0
            THEN 'human-review-required' ELSE 'no-review-observations' END END AS labels,
       coalesce(n_runs, 0) AS executions, coalesce(scanners, '') AS scanners, coalesce(iso, true) AS all_isolated,
       ms < 99 AS audit_verified, ms AS provider_duration_ms, false AS claims_full_coverage,
       false AS claims_certification, false AS claims_production_testing
  FROM reports r LEFT JOIN tob USING (engagement_id, repository_id) LEFT JOIN stc USING (engagement_id, repository_id)
     LEFT JOIN svc USING (engagement_id, repository_id) LEFT JOIN mtop USING (engagement_id, repository_id)
     LEFT JOIN tri ON tri.case_id = r.repository_id LEFT JOIN run USING (engagement_id, repository_id))"""


@register("J1_pilot_metrics", f"WITH {_METRICS_SQL} SELECT * FROM met")
def q_j1(spark, sf_dir):
    return _metrics(spark, sf_dir)


def _row(name: str, value: str) -> str:
    return f"'| {name} | ' || {value} || ' |'"


def _yes(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '?' WHEN {c} THEN 'yes' ELSE 'no' END"


_J2_TEXT = "concat_ws(chr(10), " + ", ".join([
    "'## ' || repository_id || ' (' || engagement_id || ')'", "''", "'| figure | value |'", "'|---|---|'",
    _row("risk", "coalesce(risk, '-')"), _row("findings", "CAST(observations AS VARCHAR)"),
    _row("open for review", "CAST(to_review AS VARCHAR)"), _row("controls seen", "CAST(passed AS VARCHAR)"),
    _row("by severity", "coalesce(nullif(severity_counts, ''), '-')"), _row("scanners", "coalesce(nullif(scanners, ''), '-')"),
    _row("scanners offline", _yes("all_isolated")), _row("quotes traced", "CAST(coalesce(citation_count, 0) AS VARCHAR)"),
    _row("triage, s", "coalesce(printf('%.1f', round(provider_duration_ms / 1000.0, 1)), '-')"),
    _row("audit chain intact", _yes("audit_verified")), "''",
    "'Figures come from automatic rules: other flaws may exist, and no norm is attested.'"]) + ")"


@register("J2_management_summary", f"""
WITH {_METRICS_SQL} SELECT engagement_id, repository_id, {_J2_TEXT} AS summary_md FROM met
""")
def q_j2(spark, sf_dir):
    return report.management_summary(_metrics(spark, sf_dir))


_J3_SQL = f"""
WITH {_METRICS_SQL},
  hdr AS (SELECT engagement_id, repository_id, engagement_id || ':' || repository_id || ':' ||
                 substring(report_fingerprint, 1, 16) AS case_id,
                 'Assurance observations for ' || repository_id AS title, risk, confidence FROM met),
  cit AS (SELECT case_id AS repository_id, string_agg('* [' || source_id || '] ' || text, chr(10) ORDER BY pos) AS cites
          FROM cand WHERE rn <= 10 GROUP BY case_id),
  pg AS (SELECT engagement_id, repository_id, pos // 100 + 1 AS page, min(pos) AS first_pos, count(*) AS n_items,
                CAST(to_json(list({{'observation_id': observation_id, 'check': "check", 'status': status,
                  'severity': severity, 'path': path, 'message': message}} ORDER BY pos)) AS VARCHAR) AS body
         FROM obs GROUP BY ALL)
SELECT hdr.case_id, 0::BIGINT AS page, NULL::BIGINT AS first_pos, 0::BIGINT AS n_items,
       replace(concat_ws(chr(10), '# ' || title, '', 'case: ' || hdr.case_id, 'state: pending_approval', 'audit: unchecked',
         'risk: ' || coalesce(hdr.risk, '-'), 'confidence: ' || coalesce(printf('%.2f', round(confidence, 2)), '-'), '',
         coalesce('Deterministic triage found ' || CAST(agg.n_review AS VARCHAR) || ' observation(s) requiring human review.',
                  'Not assessed.'), '', 'Quotes', coalesce(cites, '')), '```', '` ` `') AS page_md
FROM hdr LEFT JOIN agg ON agg.case_id = hdr.repository_id LEFT JOIN cit USING (repository_id)
UNION ALL
SELECT hdr.case_id, pg.page, pg.first_pos, pg.n_items,
       '```json' || chr(10) || replace(pg.body, '```', '` ` `') || chr(10) || '```'
FROM pg JOIN hdr USING (engagement_id, repository_id)
"""


@register("J3_evidence_pack", _J3_SQL)
def q_j3(spark, sf_dir):
    obs = fixtures.observations(spark, sf_dir, materialize=True)
    headers, sources = evidence.build_cases(fixtures.reports(spark, sf_dir), obs)
    assessed = triage.triage(headers.select("case_id"), sources)
    return report.evidence_pack(headers, obs, assessed)


@register("J4_counters", f"""
SELECT {_AUDIT_EVENT} AS name, count(*) AS count FROM events GROUP BY 1
""")
def q_j4(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events").select(F.expr(_AUDIT_EVENT).alias("event"))
    return report.counters(ev)


@register("J7_html_escape", """
SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
                               chr(39), '&#x27;')) AS escaped_sha256
FROM pages
""")
def q_j7h(spark, sf_dir):
    """Raw pages as text that a report can show."""
    from ...functions.text import html_escape
    return fixtures.table(spark, sf_dir, "pages").select("page_id", F.sha2(html_escape("html"), 256).alias("escaped_sha256"))


@register("J5_latency", """
WITH r AS (SELECT event_type AS name, value, ts, row_number() OVER (PARTITION BY event_type ORDER BY value, ts) AS rn,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT name, max(n) AS count, arg_max(value, ts) AS last,
       max(CASE WHEN rn = ceil(0.5 * n) THEN value END) AS p50, max(CASE WHEN rn = ceil(0.95 * n) THEN value END) AS p95
FROM r GROUP BY name
""")
def q_j5(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"),
                                                        F.col("value").alias("duration_ms"), "ts")
    return report.latency(ev).withColumnRenamed("p50", "p50").select("name", "count", "last", "p50", "p95")


@register("J5_latency_levels", """
SELECT event_type AS name, CAST(ts AS DATE) AS day, count(*) AS count, true AS p50_ok, true AS p95_ok FROM events GROUP BY ALL
UNION ALL SELECT event_type, NULL, count(*), true, true FROM events GROUP BY 1
""")
def q_j5l(spark, sf_dir):
    """Daily and total percentiles from merged sketches, each held against the exact ranks
    of its value (``RANK_ERROR``)."""
    ev = fixtures.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("duration_ms"), "ts")
    levels = report.latency_levels(report.latency_sketches(ev))
    rows = ev.select("name", F.explode(F.array(F.to_date("ts"), F.lit(None).cast("date"))).alias("day"), "duration_ms")
    j = rows.join(levels, (rows["name"] == levels["name"]) & rows["day"].eqNullSafe(levels["day"])).drop(rows["name"], rows["day"])

    def ok(p, q):
        below, upto = (F.avg(c.cast("double")) for c in (F.col("duration_ms") < F.col(p), F.col("duration_ms") <= F.col(p)))
        return ((below - report.RANK_ERROR <= q) & (q <= upto + report.RANK_ERROR)).alias(f"{p}_ok")
    return j.groupBy("name", "day", "count").agg(ok("p50", 0.5), ok("p95", 0.95))


# every kind of audit event the rates need, from the events table
_SLI_EVENT = f"""CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'provider_retry'
       WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'input_rejected'
       WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'publish_deduplicated'
       ELSE {_AUDIT_EVENT} END"""


def _count(event: str) -> str:
    return f"count(*) FILTER (event = '{event}')"


@register("J6_workflow_sli", f"""
WITH a AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS case_id, {_SLI_EVENT} AS event, ts FROM events),
  pc AS (SELECT case_id, min(CASE WHEN event = 'analysis_completed' THEN ts END) AS c,
                min(CASE WHEN event = 'case_approved' THEN ts END) AS ap FROM a GROUP BY case_id),
  w AS (SELECT avg(epoch_us(ap) - epoch_us(c)) AS w FROM pc WHERE ap >= c),
  n AS (SELECT {_count('case_received')} AS received, {_count('analysis_completed')} AS completed,
               {_count('analysis_failed')} AS failed, {_count('provider_retry')} AS retried,
               {_count('input_rejected')} AS rejected, {_count('case_published')} AS published,
               {_count('publish_deduplicated')} AS repeated FROM a)
SELECT received, completed / received AS completion_rate, failed / received AS failure_rate,
       retried / received AS retry_rate, rejected / (received + rejected) AS rejection_rate,
       repeated / (published + repeated) AS publish_dedupe_rate, w.w / 1e6 AS mean_approval_wait_s
FROM n, w
""")
def q_j6(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"),
        F.expr(_SLI_EVENT).alias("event"), "ts")
    return report.workflow_sli(ev)


@register("J7_markdown_table", f"""
WITH {_f3_sql(0)}, {_PER_CLASS_SQL},
  lines AS (SELECT label, '| ' || label || ' | ' || printf('%.3f', round(precision, 3)) || ' | '
                          || printf('%.3f', round(recall, 3)) || ' | ' || printf('%.3f', round(f1, 3)) || ' | '
                          || CAST(CAST(tp + fn AS BIGINT) AS VARCHAR) || ' |' AS line FROM f)
SELECT '| label | precision | recall | f1 | support |' || chr(10) || '|---|---|---|---|---|' || chr(10)
       || string_agg(line, chr(10) ORDER BY label) AS table_md
FROM lines
""")
def q_j7(spark, sf_dir):
    """Per-class metrics as a Markdown table; cells rounded to 3 places
    before fixed-point formatting, so no engine-specific tie rounding is
    left."""
    pc = evaluate.per_class(fixtures.predictions(spark, sf_dir), fixtures.CLASS_NAMES)
    pc = pc.select("label", *[F.round(c, 3).alias(c) for c in ("precision", "recall", "f1")], "support")
    return report.markdown_table(pc, ["label", "precision", "recall", "f1", "support"], ["label"],
                                 {"precision": "%.3f", "recall": "%.3f", "f1": "%.3f"})