"""Shared pieces of the query catalog: the registry, fixture helpers and
the SQL fragments several oracle statements use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import hashing
from ...operators import chain as chainops
from ...operators import evaluate, measure
from ...operators import evidence, scope
from ...operators import report
from ...operators import triage, validate, workflow
from ...session import scratch_path, written
from ...sources import io as sio
from ...sources import state as sstate
from ...streaming import streams
from .. import fixtures
from .. import oracle_sql as O


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conversations are valid evidence cases, what risk does each get,
    and does the quoted evidence resolve in its source?"""
    headers, sources = fixtures.conversation_cases(spark, sf_dir)
    out = workflow.analyze(
        headers, sources,
        classifier=lambda h, s: triage.keyword_classify(h, s, fixtures.CONVERSATION_TIERS),
        validators=[lambda a: validate.prohibited_claims_reason()],
    )
    return out.select("case_id", "risk", F.col("citations")[0]["quote"].alias("quote"),
                      F.coalesce("input_reason", "reason").alias("reason"), "state")


_OBS_OUT = ["engagement_id", "repository_id", "observation_id", "check", "status", "severity", "path", "message"]


_EVENT_LEVEL = ("CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' "
                "WHEN 'view' THEN 'note' WHEN 'signup' THEN 'none' ELSE event_type END")


_SUMMARY_SQL = f"""
  tot AS (SELECT engagement_id, repository_id, count(*) AS n FROM obs GROUP BY ALL),
  k AS (SELECT engagement_id, repository_id, count(*) AS k FROM sel GROUP BY ALL),
  summ AS (SELECT r.engagement_id, r.repository_id,
             CASE WHEN coalesce(n, 0) - coalesce(k, 0) > 0 THEN 'scanner-selection-summary'
                  WHEN coalesce(n, 0) = 0 THEN 'scanner-summary' END AS source_id,
             CASE WHEN coalesce(n, 0) - coalesce(k, 0) > 0 THEN
                    CAST(coalesce(n, 0) - coalesce(k, 0) AS VARCHAR) || ' lower-priority observations were preserved '
                    || 'in the raw report but omitted from model input by configured limits.'
                  WHEN coalesce(n, 0) = 0 THEN 'The authorized deterministic scan returned no observations.' END AS text,
             CAST(coalesce(k, 0) AS BIGINT) AS sel_pos
           FROM reports r LEFT JOIN tot USING (engagement_id, repository_id)
                          LEFT JOIN k USING (engagement_id, repository_id))"""


TEXT_RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "medium", "e-mail address in text", "@"),
    ("license", r"(?i)licen[sc]ed under [^.\n]*", "info", "license statement"),
    ("ipv4", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "low", "IPv4 address"),
    ("card", r"[0-9]{16}", "high", "card-like number"),
    ("token", r"(?i)(?:api[_-]?key|secret|token|password)[=:][^ \n]+", "critical", "credential-like assignment"),
)


def _rule_scan_sql() -> str:
    parts = []
    for rid, pat, sev, *_ in TEXT_RULES:
        parts.append(f"SELECT doc_id, '{rid}' AS rule_id, '{sev}' AS sev, "
                     f"regexp_extract_all(text, '{pat}') AS m FROM documents")
    return f"""
WITH r AS ({' UNION ALL '.join(parts)}),
  u AS (SELECT doc_id, rule_id, sev, unnest(m) AS mt, generate_subscripts(m, 1) AS idx FROM r)
SELECT doc_id AS text_id, rule_id, 'rule:' || rule_id || ':' || CAST(doc_id AS VARCHAR) || ':' || CAST(idx AS VARCHAR)
         AS observation_id, sev AS severity, CAST(idx AS BIGINT) AS match_index, CAST(length(mt) AS BIGINT) AS match_length
FROM u
"""


_SCANNER = ("CASE event_type WHEN 'click' THEN 'semgrep' WHEN 'view' THEN 'gitleaks' "
            "WHEN 'purchase' THEN 'osv' ELSE event_type END")


_SCOPES_SQL = """
  sc AS (SELECT 'nat-' || CAST(n_nationkey AS VARCHAR) AS engagement_id,
                CASE WHEN n_nationkey = 7 THEN 2 ELSE 1 END AS version,
                (['deny', 'local-only', 'allow', 'open'])[n_nationkey % 4 + 1] AS egress,
                DATE '2030-01-01' + CAST(n_nationkey * 30 AS INTEGER) AS expires_on
         FROM nation),
  sr AS (SELECT 'nat-' || CAST(c_nationkey AS VARCHAR) AS engagement_id,
                CASE WHEN c_acctbal < -950 THEN c_name ELSE replace(c_name, '#', '-') END AS repository_id,
                '/repos/' || CAST(c_custkey AS VARCHAR) AS path,
                ['repository-policy', lower(c_mktsegment)] AS allowed_checks
         FROM customer WHERE c_custkey % 10 <> 0)"""


_HOST_SQL = """
  u0 AS (SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc,
                lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme FROM urls0),
  u1 AS (SELECT *, regexp_replace(netloc, '^.*@', '') AS hp FROM u0),
  u2 AS (SELECT *, CASE WHEN starts_with(hp, '[') THEN regexp_extract(hp, '^\\[([^\\]]*)\\]', 1)
                        ELSE regexp_replace(hp, ':[^:]*$', '') END AS h FROM u1),
  u3 AS (SELECT *, CASE WHEN h <> '' THEN lower(h) END AS host FROM u2)"""


_REQ_CHECK = ("CASE o_orderstatus WHEN 'F' THEN 'semgrep' WHEN 'O' THEN 'osv' "
              "ELSE 'scan-' || lower(substring(o_orderpriority, 3)) END")


_TAMPER = "seq % 997 = 0"


def _allowed_sql(a: str, b: str) -> str:
    m = workflow.transition_matrix()
    return "(" + " OR ".join(f"({a} = {i} AND {b} = {j})" for i, row in enumerate(m)
                             for j, nxt in enumerate(row) if nxt >= 0) + ")"


def _next_sql(a: str, b: str) -> str:
    m = workflow.transition_matrix()
    return "CASE " + " ".join(f"WHEN {a} = {i} AND {b} = {j} THEN {nxt}" for i, row in enumerate(m)
                              for j, nxt in enumerate(row) if nxt >= 0) + f" ELSE {a} END"


_STATE_NAMES = "(['received', 'pending_approval', 'approved', 'published', 'rejected', 'failed'])"


_EV_STATE_ID = ("CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 "
                "WHEN 'purchase' THEN 4 WHEN 'error' THEN 6 END")


_FOLD_SQL = f"""
  ev AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS case_id, event_id AS seq, {_EV_STATE_ID} AS t,
                row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
  f(case_id, rn, seq, t, st_before, st) AS (
    SELECT case_id, 0, NULL::BIGINT, NULL::INTEGER, 0, 0 FROM (SELECT DISTINCT case_id FROM ev)
    UNION ALL
    SELECT e.case_id, e.rn, e.seq, e.t, f.st, {_next_sql('f.st', 'e.t')}
    FROM f JOIN ev e ON e.case_id = f.case_id AND e.rn = f.rn + 1),
  folded AS (SELECT case_id, seq, {_STATE_NAMES}[t] AS to_state,
                    CASE WHEN st_before > 0 THEN {_STATE_NAMES}[st_before] END AS from_state,
                    CASE WHEN st > 0 THEN {_STATE_NAMES}[st] END AS state,
                    {_allowed_sql('st_before', 't')} AS accepted
             FROM f WHERE rn > 0)"""


_SUBMISSIONS = f"""
  sub AS (SELECT 'cust-' || CAST(o_custkey AS VARCHAR) AS case_id, o_orderkey AS seq,
                 sha256({O.canon('o_orderpriority')} || {O.canon('o_orderstatus')}) AS fp FROM orders)"""


_ATTEMPTS = """
  att AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS case_id,
                 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt,
                 CASE event_type WHEN 'error' THEN 'transient' WHEN 'purchase' THEN 'permanent' ELSE 'success' END
                   AS outcome FROM events)"""


_SNAPSHOT = """
  last AS (SELECT user_id, arg_max(event_type, event_id) AS lt, max(event_id) AS updated_seq FROM events GROUP BY user_id),
  snap AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS case_id,
                  sha256('case:' || CAST(user_id AS VARCHAR)) AS case_fingerprint,
                  CASE lt WHEN 'signup' THEN 'received' WHEN 'view' THEN 'pending_approval' WHEN 'click' THEN 'approved'
                          WHEN 'purchase' THEN 'published' WHEN 'error' THEN 'failed' END AS state,
                  (['low', 'medium', 'high', 'critical'])[user_id % 4 + 1] AS risk,
                  sha256('assessment:' || CAST(user_id AS VARCHAR)) AS assessment_fp,
                  CASE WHEN lt IN ('click', 'purchase') THEN 'rev-' || CAST(user_id % 5 AS VARCHAR) END AS reviewer,
                  CASE WHEN lt = 'purchase' THEN 'file:handoff/approved-'
                       || substring(sha256('user-' || CAST(user_id AS VARCHAR)), 1, 20) || '.json' END AS receipt,
                  updated_seq
           FROM last)"""


_DECISIONS = ("CASE WHEN value < 100 THEN ' ' ELSE 'rev-' || CAST(event_id % 5 AS STRING) END")


def _f3_sql(off: int) -> str:
    return f"""
  e AS (SELECT vec_id AS key, 'c' || CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS lg FROM embeddings),
  c AS (SELECT *, [greatest(lg[i + {off + 1}], lg[i + {off + 11}]) FOR i IN range(10)] AS cls FROM e),
  m AS (SELECT *, list_max(cls) AS mx FROM c),
  x AS (SELECT *, [exp(v - mx) FOR v IN cls] AS ex, list_position(cls, mx) AS k FROM m),
  pr AS (SELECT key, label, 'c' || CAST(k - 1 AS VARCHAR) AS pred, ex[k] / list_sum(ex) AS confidence,
                list_position(lg, list_max(lg)) - 1 AS top_id FROM x),
  preds AS (SELECT key, label, pred, confidence, pred = label AS correct,
                   (top_id % 20 < 10 OR top_id IN ({', '.join(str(i) for i in range(off, off + 20))}))
                   AND top_id >= {off} AND top_id < {off + 20} AS free_top_is_letter FROM pr)"""


_LABELS_SQL = "(SELECT unnest(['c0','c1','c2','c3','c4','c5','c6','c7','c8','c9']) AS c)"


_PER_CLASS_SQL = f"""
  pc AS (SELECT l.c AS label,
                sum(CASE WHEN p.pred = l.c AND p.label = l.c THEN 1 ELSE 0 END)::DOUBLE AS tp,
                sum(CASE WHEN p.pred = l.c AND p.label <> l.c THEN 1 ELSE 0 END)::DOUBLE AS fp,
                sum(CASE WHEN p.pred <> l.c AND p.label = l.c THEN 1 ELSE 0 END)::DOUBLE AS fn
         FROM {_LABELS_SQL} l JOIN preds p ON TRUE GROUP BY l.c),
  prc AS (SELECT label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM pc),
  f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
                  AS f1 FROM prc)"""


_SCORED = """
  sc AS (SELECT event_id AS key, value > 50 AS correct, (user_id % 100) / 100 AS confidence FROM events),
  rk AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, key) AS rank, count(*) OVER () AS n FROM sc)"""


def _f1_sql(off: int, sfx: str) -> str:
    body = _f3_sql(off) + "," + _PER_CLASS_SQL
    for name in ("e", "c", "m", "x", "pr", "preds", "pc", "prc", "f"):
        body = body.replace(f"  {name} AS (", f"  {name}{sfx} AS (")
        for tail in (")", ",", " ", "\n"):
            body = body.replace(f"FROM {name}{tail}", f"FROM {name}{sfx}{tail}")
            body = body.replace(f"JOIN {name} ", f"JOIN {name}{sfx} ")
    return body


_SPLIT_SQL = """
  it AS (SELECT vec_id, label, sha256('42:' || CAST(vec_id AS VARCHAR)) AS h FROM embeddings),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) AS rn,
               count(*) OVER (PARTITION BY label) AS n FROM it),
  sp AS (SELECT vec_id, CAST(label AS BIGINT) AS label,
                CASE WHEN rn <= floor(0.7::DOUBLE * n) THEN 'train'
                     WHEN rn <= floor(0.7::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'test' END AS split
         FROM r)"""


_MANIFEST_SQL = """
  man AS (SELECT 'docs/' || CAST(doc_id AS VARCHAR) AS path, lang AS label,
                 CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END AS split,
                 sha256(text) AS sha256 FROM documents WHERE doc_id % 20 <> 0),
  act AS (SELECT 'docs/' || CAST(doc_id AS VARCHAR) AS path,
                 CASE WHEN doc_id % 10 = 7 THEN sha256(text || '!') ELSE sha256(text) END AS sha256
          FROM documents WHERE doc_id % 10 <> 3)"""


def _round_summary(df):
    return df.select("n", F.round("median_pct", 6).alias("median_pct"), F.round("p95_pct", 6).alias("p95_pct"),
                     "verdict")


_MEAS_SQL = r"""
  res AS (SELECT CASE WHEN l_linenumber = 7 THEN 'img_P' || CAST(l_partkey AS VARCHAR) || 'x.png'
                      ELSE printf('d%d_a%d_%s_r%d-%d-%d_P%dx.png', l_orderkey % 900 + 100, l_linenumber * 15 % 90,
                                  CASE WHEN l_returnflag = 'A' THEN 'lamp' ELSE 'sun' END, l_orderkey, l_linenumber,
                                  l_suppkey, l_partkey) END AS image,
                 l_extendedprice / l_quantity AS measured_mm, l_partkey FROM lineitem),
  tr AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) || 'x' AS object, p_retailprice AS true_mm, p_partkey FROM part),
  m AS (SELECT res.image, res.measured_mm, tr.object, tr.true_mm FROM res JOIN tr ON tr.p_partkey = res.l_partkey),
  pm AS (SELECT *, regexp_extract(image, 'd(\d+)_a(\d+)_(\w+?)_r(\d+)', 1) AS dist,
                regexp_extract(image, 'd(\d+)_a(\d+)_(\w+?)_r(\d+)', 2) AS angle,
                regexp_extract(image, 'd(\d+)_a(\d+)_(\w+?)_r(\d+)', 3) AS light,
                regexp_extract(image, 'd(\d+)_a(\d+)_(\w+?)_r(\d+)', 4) AS "repeat"
         FROM m WHERE regexp_matches(image, 'd(\d+)_a(\d+)_(\w+?)_r(\d+)')),
  errs AS (SELECT *, measured_mm - true_mm AS err_mm, 100.0 * abs(measured_mm - true_mm) / true_mm AS rel_pct FROM pm)"""


_RESP_SQL = f"""
  rs AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, turn + 1 AS attempt, turn, text, role,
                (['low', 'medium', 'high', 'critical', 'severe'])[(conv_id + turn) % 5 + 1] AS risk0,
                CASE WHEN (conv_id + turn) % 6 = 0 THEN 'The system is compliant with policy.'
                     ELSE text END AS summary0,
                CASE WHEN (conv_id + turn) % 7 = 0 THEN ['review', 'Certified '] ELSE [role] END AS labels0,
                CASE WHEN turn % 3 = 0 THEN CAST((conv_id + turn) % 2 AS VARCHAR) || '.5'
                     WHEN turn % 3 = 1 THEN '0.' || CAST((conv_id + turn) % 10 AS VARCHAR) ELSE 'high' END AS conf0,
                NOT (turn = 0 AND conv_id % 4 = 0) AS is_json,
                turn <> 1 AS has_cit
         FROM conversations),
  parsed AS (SELECT case_id, attempt, turn, text,
                    CASE WHEN is_json THEN risk0 END AS risk, CASE WHEN is_json THEN summary0 END AS summary,
                    CASE WHEN is_json THEN labels0 ELSE [] END AS labels,
                    CASE WHEN is_json AND has_cit THEN 1 ELSE 0 END AS n_citations,
                    CASE WHEN is_json THEN TRY_CAST(conf0 AS DOUBLE) END AS confidence,
                    coalesce(is_json AND risk0 IN ('low', 'medium', 'high', 'critical') AND has_cit
                             AND TRY_CAST(conf0 AS DOUBLE) IS NOT NULL, false) AS parse_ok
             FROM rs)"""


def _banned_sql(labels: str, summary: str) -> str:
    lab = ", ".join(f"'{w}'" for w in validate.PROHIBITED_LABELS)
    norm = f"lower(regexp_replace(regexp_replace({summary}, '{O.WS_RUN}', ' ', 'g'), '{O.STRIP}', '', 'g'))"
    phrases = " OR ".join(f"contains({norm}, '{p}')" for p in validate.PROHIBITED_PHRASES)
    return (f"CASE WHEN len(list_intersect([lower(regexp_replace(x, '{O.STRIP}', '', 'g')) FOR x IN {labels}], "
            f"[{lab}])) > 0 THEN 'assessment contains a prohibited assurance label' "
            f"WHEN coalesce({phrases}, false) THEN 'assessment contains a prohibited assurance claim' END")


_CITES = """
  cit AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, turn AS cpos,
                 CASE WHEN turn % 3 = 0 THEN CAST(turn AS VARCHAR) WHEN turn % 3 = 1 THEN '99'
                      ELSE CAST(turn - 1 AS VARCHAR) END AS source_id,
                 substring(text, 3, 25) AS quote FROM conversations)"""


_TRIAGE_SQL = f"""
  src AS (SELECT repository_id AS case_id, rn - 1 AS pos, observation_id AS source_id, text FROM sel
          UNION ALL SELECT repository_id, sel_pos, source_id, text FROM summ WHERE source_id IS NOT NULL),
  p AS (SELECT *, json_valid(text) AND starts_with(ltrim(text), '{{') AS obj FROM src),
  q AS (SELECT *, CASE WHEN obj THEN coalesce(json_extract_string(text, '$.status'), 'None') ELSE 'review' END = 'review'
                    AS review,
               CASE CASE WHEN obj THEN coalesce(json_extract_string(text, '$.severity'), 'None') ELSE 'low' END
                 WHEN 'info' THEN 0 WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3
                 ELSE 1 END AS ord FROM p),
  agg AS (SELECT case_id, sum(CASE WHEN review THEN 1 ELSE 0 END) AS n_review,
                 max(CASE WHEN review THEN ord END) AS ord_r, max(ord) AS ord_a FROM q GROUP BY case_id),
  cand AS (SELECT q.*, row_number() OVER (PARTITION BY q.case_id ORDER BY pos) AS rn FROM q JOIN agg USING (case_id)
           WHERE (agg.n_review > 0 AND q.review) OR agg.n_review = 0),
  c AS (SELECT case_id, count(*) AS n_citations, arg_min(source_id, pos) AS first_citation FROM cand WHERE rn <= 10
        GROUP BY case_id),
  tri AS (SELECT agg.case_id,
                 (['low', 'medium', 'high', 'critical'])[coalesce(CASE WHEN n_review > 0 THEN ord_r ELSE ord_a END, 0) + 1]
                   AS risk, CAST(n_review AS BIGINT) AS n_review, c.n_citations, c.first_citation
          FROM agg JOIN c USING (case_id))"""


def _triage_by_repo(spark, sf_dir, materialize=False):
    """Observations, the per-repository case sources and their triage.
    ``materialize`` writes the observation table for callers that also
    fingerprint it (triage alone reads it twice, cheaply, with the position
    window pruned away)."""
    obs = fixtures.observations(spark, sf_dir, materialize=materialize)
    sel = written(evidence.select_evidence(obs).select(
        "engagement_id", "repository_id", "sel_pos", "observation_id", "text"), "selected")
    summ = evidence.selection_summary(fixtures.reports(spark, sf_dir), obs, sel)
    src = sel.select(F.col("repository_id").alias("case_id"), F.col("sel_pos").alias("pos"),
                     F.col("observation_id").alias("source_id"), "text").unionByName(
        summ.select(F.col("repository_id").alias("case_id"), F.col("sel_pos").alias("pos"), "source_id", "text"))
    src = written(src, "sources")   # the case sources are read by several steps
    return obs, src, triage.triage(src.select("case_id").distinct(), src)


_EXEC_SQL = """
  ex AS (SELECT 'eng-1' AS engagement_id, 'repo-' || CAST(user_id % 100 + 1 AS VARCHAR) AS repository_id,
                event_type AS scanner, value > 2 AS iso, value AS ms FROM events)"""


def _executions(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events")
    return ev.select(F.lit("eng-1").alias("engagement_id"),
                     F.concat(F.lit("repo-"), (F.col("user_id") % 100 + 1).cast("string")).alias("repository_id"),
                     F.col("event_type").alias("scanner"), (F.col("value") > 2).alias("network_isolated"),
                     F.col("value").alias("duration_ms"))


def _metrics(spark, sf_dir):
    obs, _, tri = _triage_by_repo(spark, sf_dir, materialize=True)
    key = ["engagement_id", "repository_id"]
    a = tri.select(F.lit("eng-1").alias("engagement_id"), F.col("case_id").alias("repository_id"),
                   "risk", "confidence", "citations", "labels")
    runs = _executions(spark, sf_dir)
    checks = runs.groupBy(*key).agg((F.max("duration_ms") < 99).alias("valid"))
    longest = runs.groupBy(*key).agg(F.max("duration_ms").alias("duration_ms"))
    return report.pilot_metrics(fixtures.reports(spark, sf_dir), obs, a, runs, checks, longest)


_AUDIT_EVENT = ("CASE event_type WHEN 'signup' THEN 'case_received' WHEN 'view' THEN 'analysis_completed' "
                "WHEN 'click' THEN 'case_approved' WHEN 'purchase' THEN 'case_published' "
                "WHEN 'error' THEN 'analysis_failed' END")


def _state_parts(spark):
    """State-store partitions of the replay streams: the session's cores
    (the replayed tables are small; a production stream sizes this for its
    key count)."""
    return max(2, spark.sparkContext.defaultParallelism)


def _replayed_events(spark, sf_dir, name, run, **how):
    """Events arrive slice by slice; ``run(stream, out, checkpoint)`` goes on after each.  Returns the output folder."""
    inp, out, ckpt = streams.new_run_paths(spark, name)
    events = fixtures.table(spark, sf_dir, "events")
    streams.replay(events, "ts", inp, lambda: run(streams.stream_files(spark, inp, events.schema, None), out, ckpt), **how)
    return out


_K1_SQL = """
WITH e AS (SELECT epoch_us(ts) AS t, event_type FROM events),
  wm AS (SELECT max(t) - 3600000000 AS wm FROM e),
  w AS (SELECT (t // 86400000000) * 86400000000 AS ws, event_type, count(*) AS n FROM e GROUP BY ALL)
SELECT ws AS window_start, ws + 86400000000 AS window_end, event_type, n FROM w, wm WHERE ws + 86400000000 <= wm.wm
"""


_K6_SQL = """
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
  wm AS (SELECT max(t) - 3600000000 AS wm FROM e),
  g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS brk
        FROM e),
  s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM g),
  ss AS (SELECT user_id, min(t) AS session_start, max(t) + 21600000000 AS session_end, count(*) AS n
         FROM s GROUP BY user_id, sid)
SELECT user_id, session_start, session_end, n FROM ss, wm WHERE session_end <= wm.wm
"""


__all__ = [
    "Callable",
    "DataFrame",
    "SparkSession",
    "F",
    "triage",
    "validate",
    "workflow",
    "fixtures",
    "O",
    "QUERIES",
    "ORACLES",
    "register",
    "flagship",
    "evidence",
    "scope",
    "_OBS_OUT",
    "_EVENT_LEVEL",
    "_SUMMARY_SQL",
    "TEXT_RULES",
    "_rule_scan_sql",
    "_SCANNER",
    "_SCOPES_SQL",
    "_HOST_SQL",
    "_REQ_CHECK",
    "hashing",
    "chainops",
    "_TAMPER",
    "_allowed_sql",
    "_next_sql",
    "_STATE_NAMES",
    "_EV_STATE_ID",
    "_FOLD_SQL",
    "_SUBMISSIONS",
    "_ATTEMPTS",
    "_SNAPSHOT",
    "_DECISIONS",
    "evaluate",
    "measure",
    "_f3_sql",
    "_LABELS_SQL",
    "_PER_CLASS_SQL",
    "_SCORED",
    "_f1_sql",
    "_SPLIT_SQL",
    "_MANIFEST_SQL",
    "_round_summary",
    "_MEAS_SQL",
    "_RESP_SQL",
    "_banned_sql",
    "_CITES",
    "_TRIAGE_SQL",
    "_triage_by_repo",
    "report",
    "_EXEC_SQL",
    "_executions",
    "_metrics",
    "_AUDIT_EVENT",
    "scratch_path",
    "sio",
    "sstate",
    "streams",
    "_state_parts",
    "_replayed_events",
    "_K1_SQL",
    "_K6_SQL",
]
