"""Registered queries, group G (workflow): G7_analyze, G4_fold_states, G4_final_states, G1_admit, G1_admit_with_state, G2_retry_outcome, G3_backoff_schedule, G5_approve, G6_publish, G8_case_summaries, G9_lookup."""

from ._shared import *  # noqa: F401,F403
from ._shared import ORACLES, register  # noqa: F401


register("G7_analyze", f"""
WITH {O.CONV_SOURCES}, {O.e1_reason()},
  cls AS (SELECT case_id, max({O.tier_case(fixtures.CONVERSATION_TIERS)}) AS tier,
                 arg_min(source_id, pos) AS sid, arg_min({O.first_line('text')}, pos) AS quote
          FROM src WHERE case_id IN (SELECT case_id FROM e1 WHERE reason IS NULL) GROUP BY case_id)
SELECT e1.case_id,
       {O.RISK_NAME.format(x='cls.tier')} AS risk,
       cls.quote AS quote,
       coalesce(e1.reason, CASE WHEN {O.blank('cls.quote')} THEN
           'citation quote does not resolve in source: ' || cls.sid END) AS reason,
       CASE WHEN e1.reason IS NOT NULL THEN NULL
            WHEN {O.blank('cls.quote')} THEN 'failed' ELSE 'pending_approval' END AS state
FROM e1 LEFT JOIN cls USING (case_id)
""")(flagship)


@register("G4_fold_states", f"""
WITH RECURSIVE {_FOLD_SQL}
SELECT case_id, seq, to_state, from_state, state, accepted FROM folded
""")
def q_g4(spark, sf_dir):
    return workflow.fold_states(fixtures.transitions(spark, sf_dir))


@register("G4_fold_states_relaid", f"""
WITH RECURSIVE {_FOLD_SQL}
SELECT case_id, seq, to_state, from_state, state, accepted FROM folded
""")
def q_g4r(spark, sf_dir):
    """The fold under a union of two folds and fewer partitions: the result
    depends on the data's own partition numbers, not on the tasks'."""
    ev = fixtures.transitions(spark, sf_dir)
    odd = F.pmod(F.xxhash64("case_id"), F.lit(2)) == 1
    return workflow.fold_states(ev.where(~odd)).unionByName(workflow.fold_states(ev.where(odd))).coalesce(2)


@register("G4_final_states", f"""
WITH RECURSIVE {_FOLD_SQL}
SELECT case_id, arg_max(state, seq) AS state, CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS accepted,
       CAST(sum(CASE WHEN accepted THEN 0 ELSE 1 END) AS BIGINT) AS rejected
FROM folded GROUP BY case_id
""")
def q_g4f(spark, sf_dir):
    return workflow.final_states(workflow.fold_states(fixtures.transitions(spark, sf_dir)))


@register("G1_admit", f"""
WITH {_SUBMISSIONS},
  first AS (SELECT case_id, arg_min(fp, seq) AS stored FROM sub GROUP BY case_id),
  fm AS (SELECT s.case_id, min(s.seq) AS first_match FROM sub s JOIN first f USING (case_id)
         WHERE s.fp = f.stored GROUP BY s.case_id)
SELECT s.case_id, s.seq, s.fp AS fingerprint,
       CASE WHEN s.fp <> f.stored THEN 'conflict' WHEN s.seq = fm.first_match THEN 'new' ELSE 'deduplicated' END
         AS admission
FROM sub s JOIN first f USING (case_id) LEFT JOIN fm USING (case_id)
""")
def q_g1(spark, sf_dir):
    return workflow.admit(fixtures.submissions(spark, sf_dir))


@register("G1_admit_with_state", f"""
WITH {_SUBMISSIONS},
  st AS (SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS case_id,
                sha256({O.canon("'1-URGENT'")} || {O.canon("'O'")}) AS st_fp,
                CASE WHEN c_custkey % 10 = 0 THEN 'failed' ELSE 'pending_approval' END AS st_state
         FROM customer WHERE c_custkey % 5 = 0),
  first AS (SELECT case_id, coalesce(st.st_fp, arg_min(fp, seq)) AS stored, st.st_state
            FROM sub LEFT JOIN st USING (case_id) GROUP BY case_id, st.st_fp, st.st_state),
  fm AS (SELECT s.case_id, min(s.seq) AS first_match FROM sub s JOIN first f USING (case_id)
         WHERE s.fp = f.stored GROUP BY s.case_id)
SELECT s.case_id, s.seq, s.fp AS fingerprint,
       CASE WHEN s.fp <> f.stored THEN 'conflict'
            WHEN s.seq = fm.first_match AND f.st_state IS NULL THEN 'new'
            WHEN s.seq = fm.first_match AND f.st_state = 'failed' THEN 'retried'
            ELSE 'deduplicated' END AS admission
FROM sub s JOIN first f USING (case_id) LEFT JOIN fm USING (case_id)
""")
def q_g1s(spark, sf_dir):
    return workflow.admit(fixtures.submissions(spark, sf_dir), fixtures.submission_state(spark, sf_dir))


@register("G1_admit_outcomes", f"""
WITH RECURSIVE sub AS (
    SELECT 'cust-' || CAST(o_custkey AS VARCHAR) AS case_id, o_orderkey AS seq, sha256({O.canon('o_orderstatus')}) AS fp,
           CASE WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'rejected' ELSE 'success' END AS outcome,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
  st AS (SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS case_id, sha256({O.canon("'F'")}) AS fp,
                CASE WHEN c_custkey % 10 = 0 THEN 'failed' ELSE 'pending_approval' END AS state
         FROM customer WHERE c_custkey % 5 = 0),
  one AS (   -- one submission after the other: what is stored before it, and its admission
    SELECT DISTINCT sub.case_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS fp,
           CAST(NULL AS VARCHAR) AS admission, st.fp AS stored, st.state FROM sub LEFT JOIN st USING (case_id)
    UNION ALL
    SELECT s.case_id, s.rn, s.seq, s.fp,
           CASE WHEN o.stored IS NULL THEN 'new' WHEN o.stored <> s.fp THEN 'conflict'
                WHEN o.state <> 'failed' THEN 'deduplicated' ELSE 'retried' END,
           CASE WHEN o.stored IS NULL AND s.outcome <> 'rejected' THEN s.fp ELSE o.stored END,
           CASE WHEN o.stored IS NULL THEN CASE s.outcome WHEN 'failed' THEN 'failed' WHEN 'success' THEN 'pending_approval' END
                WHEN o.stored = s.fp AND o.state = 'failed' AND s.outcome = 'success' THEN 'pending_approval' ELSE o.state END
    FROM one o JOIN sub s ON s.case_id = o.case_id AND s.rn = o.rn + 1)
SELECT case_id, seq, fp AS fingerprint, admission FROM one WHERE rn > 0
""")
def q_g1o(spark, sf_dir):
    """Submissions whose analyses fail or are rejected within the batch: later
    ones retry them (the SQL goes through them one by one)."""
    from ...functions.hashing import fingerprint
    state = fixtures.submission_state(spark, sf_dir).withColumn("case_fingerprint", fingerprint(F.lit("F")))
    return workflow.admit(fixtures.submission_outcomes(spark, sf_dir), state)


@register("G2_retry_outcome", f"""
WITH {_ATTEMPTS},
  a AS (SELECT case_id, min(CASE WHEN outcome <> 'transient' THEN attempt END) AS dec,
               arg_min(CASE WHEN outcome <> 'transient' THEN outcome END,
                       CASE WHEN outcome <> 'transient' THEN attempt END) AS dec_outcome,
               sum(CASE WHEN outcome = 'transient' THEN 1 ELSE 0 END) AS nt
        FROM att WHERE attempt <= 3 GROUP BY case_id),
  b AS (SELECT *, CASE WHEN dec_outcome = 'success' THEN 'pending_approval' WHEN dec_outcome IS NOT NULL THEN 'failed'
                       WHEN nt >= 3 THEN 'failed' ELSE 'retrying' END AS final_state FROM a)
SELECT case_id, final_state, CAST(CASE WHEN dec IS NOT NULL THEN dec - 1 ELSE nt END AS BIGINT) AS provider_retries,
       CAST(CASE WHEN final_state = 'failed' THEN 1 ELSE 0 END AS BIGINT) AS failure_events,
       CAST(coalesce(dec, nt) AS BIGINT) AS attempts_used
FROM b
""")
def q_g2(spark, sf_dir):
    return workflow.retry_outcome(fixtures.attempts(spark, sf_dir))


@register("G3_backoff_schedule", f"""
WITH {_ATTEMPTS},
  d AS (SELECT case_id, min(CASE WHEN outcome <> 'transient' THEN attempt END) AS dec FROM att WHERE attempt <= 3
        GROUP BY case_id),
  a AS (SELECT att.*, CASE WHEN outcome = 'transient' AND attempt < 3 THEN 0.01::DOUBLE * pow(2.0, attempt - 1) END
                 AS delay_s
        FROM att JOIN d USING (case_id) WHERE attempt <= 3 AND (d.dec IS NULL OR attempt <= d.dec))
SELECT case_id, CAST(attempt AS BIGINT) AS attempt, outcome, delay_s,
       coalesce(sum(delay_s) OVER (PARTITION BY case_id ORDER BY attempt
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS cumulative_wait_s
FROM a
""")
def q_g3(spark, sf_dir):
    return workflow.backoff_schedule(fixtures.attempts(spark, sf_dir))


@register("G5_approve", f"""
WITH {_SNAPSHOT},
  dec AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS case_id, event_id AS seq, {_DECISIONS} AS reviewer
          FROM events WHERE event_type = 'view'
          UNION ALL SELECT 'ghost-' || CAST(event_id AS VARCHAR), event_id, 'rev-1' FROM events WHERE event_id % 500 = 0),
  d AS (SELECT dec.*, snap.state AS st FROM dec LEFT JOIN snap USING (case_id)),
  ok AS (SELECT case_id, min(seq) AS ok_seq FROM d
         WHERE st = 'pending_approval' AND NOT {O.blank('reviewer')} GROUP BY case_id),
  e AS (SELECT d.*, CASE WHEN ok.ok_seq IS NOT NULL AND d.seq > ok.ok_seq THEN 'approved' ELSE d.st END AS eff
        FROM d LEFT JOIN ok USING (case_id))
SELECT case_id, seq, reviewer,
       CASE WHEN st IS NULL THEN 'error' WHEN eff = 'published' THEN 'noop' WHEN eff <> 'pending_approval' THEN 'error'
            WHEN {O.blank('reviewer')} THEN 'error' ELSE 'approved' END AS outcome,
       CASE WHEN st IS NULL THEN 'unknown case_id: ' || case_id WHEN eff = 'published' THEN NULL
            WHEN eff <> 'pending_approval' THEN 'cannot approve a case in state ' || eff
            WHEN {O.blank('reviewer')} THEN 'a named reviewer is required' END AS message
FROM e
""")
def q_g5(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events")
    dec = ev.where(F.col("event_type") == "view").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"),
        F.col("event_id").alias("seq"), F.expr(_DECISIONS).alias("reviewer")).unionByName(
        ev.where(F.col("event_id") % 500 == 0).select(
            F.concat(F.lit("ghost-"), F.col("event_id").cast("string")).alias("case_id"),
            F.col("event_id").alias("seq"), F.lit("rev-1").alias("reviewer")))
    return workflow.approve(fixtures.state_snapshot(spark, sf_dir), dec)


@register("G5_apply_approvals", f"""
WITH {_SNAPSHOT}, o AS ({ORACLES['G5_approve']})
SELECT s.case_id, s.case_fingerprint, coalesce(o.outcome, s.state) AS state, coalesce(o.reviewer, s.reviewer) AS reviewer, s.updated_seq
FROM snap s LEFT JOIN (SELECT * FROM o WHERE outcome = 'approved') o USING (case_id)
""")
def q_g5a(spark, sf_dir):
    """The state table after those decisions."""
    snap = fixtures.state_snapshot(spark, sf_dir)
    return workflow.apply_approvals(snap, q_g5(spark, sf_dir)).select("case_id", "case_fingerprint", "state", "reviewer", "updated_seq")


@register("G6_publish", f"""
WITH {_SNAPSHOT},
  rq AS (SELECT 'user-' || CAST(user_id AS VARCHAR) AS case_id, event_id AS seq FROM events
         WHERE event_type IN ('purchase', 'click')),
  exported AS (SELECT case_fingerprint || ':' || assessment_fp AS k FROM snap
               WHERE CAST(substring(case_id, 6) AS BIGINT) % 4 = 0),
  r AS (SELECT rq.*, snap.state AS st, snap.receipt AS old, snap.case_fingerprint || ':' || snap.assessment_fp AS k
        FROM rq LEFT JOIN snap USING (case_id)),
  fst AS (SELECT case_id, min(seq) AS f FROM r WHERE st = 'approved' GROUP BY case_id),
  o AS (SELECT r.*, fst.f,
               CASE WHEN st IS NULL THEN 'error' WHEN st = 'published' THEN 'deduplicated'
                    WHEN fst.f IS NOT NULL AND seq = fst.f THEN 'published'
                    WHEN fst.f IS NOT NULL THEN 'deduplicated' ELSE 'blocked' END AS outcome,
               'file:handoff/approved-' || substring(sha256(case_id), 1, 20) || '.json' AS nr
        FROM r LEFT JOIN fst USING (case_id))
SELECT case_id, seq, outcome,
       CASE WHEN outcome = 'published' THEN nr WHEN st = 'published' THEN old WHEN outcome = 'deduplicated' THEN nr END
         AS receipt,
       k AS idempotency_key,
       outcome = 'published' AND k NOT IN (SELECT k FROM exported) AS export
FROM o
""")
def q_g6(spark, sf_dir):
    ev = fixtures.table(spark, sf_dir, "events")
    rq = ev.where(F.col("event_type").isin("purchase", "click")).select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"), F.col("event_id").alias("seq"))
    snap = fixtures.state_snapshot(spark, sf_dir)
    exported = snap.where(F.substring("case_id", 6, 100).cast("bigint") % 4 == 0).select(
        hashing.idempotency_key("case_fingerprint", "assessment_fp").alias("idempotency_key"))
    return workflow.publish(snap, rq, exported).select("case_id", "seq", "outcome", "receipt",
                                                         "idempotency_key", "export")


@register("G8_case_summaries", f"""
WITH {_SNAPSHOT}
SELECT case_id, state, risk, reviewer, updated_seq FROM snap
""")
def q_g8(spark, sf_dir):
    return workflow.case_summaries(fixtures.state_snapshot(spark, sf_dir))


@register("G9_lookup", f"""
WITH {_SNAPSHOT}
SELECT w.case_id, snap.state, snap.risk,
       CASE WHEN snap.state IS NULL THEN 'unknown case_id: ' || w.case_id END AS error
FROM (SELECT 'user-' || CAST(c_custkey AS VARCHAR) AS case_id FROM customer) w LEFT JOIN snap USING (case_id)
""")
def q_g9(spark, sf_dir):
    wanted = fixtures.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("case_id"))
    return workflow.lookup(fixtures.state_snapshot(spark, sf_dir), wanted).select("case_id", "state", "risk", "error")


def _stored_state(spark, sf_dir):
    """A state snapshot over the conversation cases: every third case is
    stored with its own fingerprint (failed when its id is a multiple of 6),
    the next third with another fingerprint; the rest is unknown."""
    headers, sources = fixtures.conversation_cases(spark, sf_dir)
    fps = hashing.case_fingerprints(headers, sources)
    cid = F.col("case_id").cast("bigint")
    return fps.where(cid % 3 != 2).select(
        "case_id",
        F.when(cid % 3 == 0, F.col("fingerprint")).otherwise(F.sha2(F.lit("other"), 256)).alias("case_fingerprint"),
        F.when(cid % 6 == 0, F.lit("failed")).otherwise(F.lit("pending_approval")).alias("state"))


@register("G7_analyze_admission", f"""
WITH {O.CONV_SOURCES}, {O.e1_reason()},
  leaf AS (SELECT case_id, pos, sha256({O.canon('source_id')} || {O.canon('text')}) AS leaf FROM src),
  {O.merkle('leaf', 'case_id', 'pos', 'leaf')},
  nsrc AS (SELECT case_id, count(*) AS n FROM src GROUP BY case_id),
  fp AS (SELECT hdr.case_id,
                sha256({O.canon('hdr.case_id')} || {O.canon('hdr.title')} || {O.canon('nsrc.n')} || mtop.tree) AS fp
         FROM hdr JOIN nsrc USING (case_id) JOIN mtop USING (case_id)),
  stored AS (SELECT case_id, CASE WHEN CAST(case_id AS BIGINT) % 3 = 0 THEN fp ELSE sha256('other') END AS st_fp,
                CASE WHEN CAST(case_id AS BIGINT) % 6 = 0 THEN 'failed' ELSE 'pending_approval' END AS st_state
         FROM fp WHERE CAST(case_id AS BIGINT) % 3 <> 2),
  adm AS (SELECT fp.case_id, stored.st_state,
                 CASE WHEN stored.st_fp IS NULL THEN 'new' WHEN stored.st_fp <> fp.fp THEN 'conflict'
                      WHEN stored.st_state <> 'failed' THEN 'deduplicated' ELSE 'retried' END AS admission
          FROM fp LEFT JOIN stored USING (case_id)),
  cls AS (SELECT case_id, max({O.tier_case(fixtures.CONVERSATION_TIERS)}) AS tier,
                 arg_min({O.first_line('text')}, pos) AS quote FROM src GROUP BY case_id)
SELECT adm.case_id, adm.admission,
       CASE WHEN adm.admission IN ('new', 'retried') AND e1.reason IS NULL THEN {O.RISK_NAME.format(x='cls.tier')} END
         AS risk,
       CASE WHEN adm.admission IN ('deduplicated', 'conflict') THEN adm.st_state
            WHEN e1.reason IS NOT NULL THEN NULL
            WHEN {O.blank('cls.quote')} THEN 'failed' ELSE 'pending_approval' END AS state
FROM adm JOIN e1 USING (case_id) JOIN cls USING (case_id)
""")
def q_g7a(spark, sf_dir):
    """Analysis against a stored state: new, deduplicated, conflicting and
    retried cases (fingerprints compared, only new and retried cases run)."""
    headers, sources = fixtures.conversation_cases(spark, sf_dir)
    out = workflow.analyze(
        headers, sources,
        classifier=lambda h, s: triage.keyword_classify(h, s, fixtures.CONVERSATION_TIERS),
        validators=[lambda a: validate.prohibited_claims_reason()],
        state=_stored_state(spark, sf_dir))
    return out.select("case_id", "admission", "risk", "state")


_G7_LOG = f"""
WITH {O.CONV_SOURCES}, {O.e1_reason()},
  leaf AS (SELECT case_id, pos, sha256({O.canon('source_id')} || {O.canon('text')}) AS leaf FROM src),
  {O.merkle('leaf', 'case_id', 'pos', 'leaf')},
  nsrc AS (SELECT case_id, count(*) AS n FROM src GROUP BY case_id),
  fp AS (SELECT hdr.case_id, sha256({O.canon('hdr.case_id')} || {O.canon('hdr.title')} || {O.canon('nsrc.n')} || mtop.tree) AS fp
         FROM hdr JOIN nsrc USING (case_id) JOIN mtop USING (case_id)),
  adm AS (SELECT case_id, CASE CAST(case_id AS BIGINT) % 3 WHEN 2 THEN 'new' WHEN 1 THEN 'conflict'
                               ELSE CASE WHEN CAST(case_id AS BIGINT) % 6 = 0 THEN 'retried' ELSE 'deduplicated' END END AS admission
          FROM fp),
  att AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, turn + 1 AS attempt, 'no answer for ' || role AS reason,
                 CASE WHEN (conv_id * 3 + turn) % 4 < 2 THEN 'transient' WHEN (conv_id * 3 + turn) % 4 = 2 THEN 'success'
                      ELSE 'permanent' END AS outcome FROM conversations WHERE conv_id % 5 <> 4 AND turn < 3),
  dec AS (SELECT case_id, min(attempt) FILTER (WHERE outcome <> 'transient') AS dec, count(*) AS n FROM att GROUP BY case_id),
  log AS (SELECT dec.case_id, dec.dec, dec.n, att.outcome, att.reason FROM dec
          LEFT JOIN att ON att.case_id = dec.case_id AND att.attempt = dec.dec),
  cls AS (SELECT case_id, max({O.tier_case(fixtures.CONVERSATION_TIERS)}) AS tier, arg_min(source_id, pos) AS sid,
                 arg_min({O.first_line('text')}, pos) AS quote FROM src GROUP BY case_id),
  res AS (SELECT adm.case_id, adm.admission, e1.reason AS input_reason,
                 adm.admission IN ('new', 'retried') AND e1.reason IS NULL AS ran,
                 log.case_id IS NOT NULL AND log.dec IS NULL AND log.n < 3 AS waits,
                 CASE WHEN log.outcome = 'permanent' THEN log.reason WHEN log.case_id IS NOT NULL AND log.dec IS NULL AND log.n >= 3
                      THEN 'the provider failed' END AS provider,
                 CASE WHEN {O.blank('cls.quote')} THEN 'citation quote does not resolve in source: ' || cls.sid END AS grounding,
                 {O.RISK_NAME.format(x='cls.tier')} AS risk, coalesce(log.dec, log.n + 1, 1) AS stop
          FROM adm JOIN e1 USING (case_id) JOIN cls USING (case_id) LEFT JOIN log USING (case_id))"""


def _logged(spark, sf_dir):
    headers, sources = fixtures.conversation_cases(spark, sf_dir)
    return workflow.analyze(
        headers, sources,
        classifier=lambda h, s: triage.keyword_classify(h, s, fixtures.CONVERSATION_TIERS),
        validators=[lambda a: validate.prohibited_claims_reason()],
        state=_stored_state(spark, sf_dir), attempts=fixtures.provider_log(spark, sf_dir))


@register("G7_analyze_attempts", _G7_LOG + """
SELECT case_id, admission, CASE WHEN ran AND NOT waits AND provider IS NULL THEN risk END AS risk,
       CASE WHEN ran AND NOT waits THEN coalesce(provider, grounding) END AS reason,
       CASE WHEN ran THEN CAST(stop - 1 AS BIGINT) END AS provider_retries,
       CASE WHEN admission = 'deduplicated' OR admission = 'conflict' THEN 'pending_approval' WHEN input_reason IS NOT NULL THEN NULL
            WHEN waits THEN 'received' WHEN provider IS NOT NULL OR grounding IS NOT NULL THEN 'failed' ELSE 'pending_approval' END AS state
FROM res
""")
def q_g7t(spark, sf_dir):
    """Analysis with the provider's log: transient and permanent failures, cases
    that still wait for an answer, and cases answered at once."""
    out = _logged(spark, sf_dir)
    return out.select("case_id", "admission", "risk", "reason",
                      F.when(F.col("retries").isNotNull() | (F.col("admission").isin("new", "retried") & F.col("input_reason").isNull()),
                             F.coalesce(F.size("retries"), F.lit(0)).cast("bigint")).alias("provider_retries"), "state")


_G7_EVENTS = _G7_LOG + """,
  ev AS (
    SELECT case_id, 0 AS o, 0 AS i, CASE admission WHEN 'deduplicated' THEN 'analysis_deduplicated' ELSE 'analysis_retried' END AS event,
           NULL::BIGINT AS attempt, NULL::VARCHAR AS reason, NULL::VARCHAR AS risk FROM res WHERE admission IN ('deduplicated', 'retried')
    UNION ALL SELECT case_id, 1, 0, 'input_rejected', NULL, input_reason, NULL FROM res WHERE admission IN ('new', 'retried') AND input_reason IS NOT NULL
    UNION ALL SELECT case_id, 1, 0, 'case_received', NULL, NULL, NULL FROM res WHERE ran
    UNION ALL SELECT res.case_id, 2, att.attempt, 'provider_retry', att.attempt, att.reason, NULL
              FROM res JOIN att ON att.case_id = res.case_id AND att.attempt < res.stop WHERE ran
    UNION ALL SELECT case_id, 3, 0, 'analysis_failed', NULL, coalesce(provider, grounding), NULL FROM res
              WHERE ran AND NOT waits AND coalesce(provider, grounding) IS NOT NULL
    UNION ALL SELECT case_id, 3, 0, 'analysis_completed', NULL, NULL, risk FROM res
              WHERE ran AND NOT waits AND coalesce(provider, grounding) IS NULL)"""


@register("G7_analysis_events", _G7_EVENTS + """
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY o, i) - 1 AS INTEGER) AS step, event, attempt, reason, risk FROM ev
""")
def q_g7v(spark, sf_dir):
    """The audit rows of that analysis, retries among them."""
    return workflow.analysis_events(_logged(spark, sf_dir))


@register("J6_analysis_sli", _G7_EVENTS + """
SELECT CAST(count(*) FILTER (WHERE event = 'case_received') AS BIGINT) AS received,
       CAST(count(*) FILTER (WHERE event = 'provider_retry') AS BIGINT) AS retried,
       CAST(count(*) FILTER (WHERE event = 'analysis_failed') AS BIGINT) AS failed,
       CAST(count(*) FILTER (WHERE event = 'analysis_completed') AS BIGINT) AS completed FROM ev
""")
def q_j6a(spark, sf_dir):
    """Retries, failures and completions counted from the audit chain of that analysis:
    its events go through B3 and are verified by B4 on the way."""
    rows = workflow.analysis_events(_logged(spark, sf_dir)).select(
        F.col("case_id").alias("chain"), F.col("step").cast("bigint").alias("seq"), F.col("step").cast("bigint").alias("ts_us"), "event", "case_id",
        F.create_map(F.lit("attempt"), F.coalesce(F.col("attempt").cast("string"), F.lit("")), F.lit("reason"), F.coalesce("reason", F.lit("")),
                     F.lit("risk"), F.coalesce("risk", F.lit(""))).alias("details"))
    audit = chainops.chain_append(rows)
    n = lambda e: F.count(F.when(F.col("event") == e, True)).cast("bigint")
    return audit.join(chainops.chain_verify(audit).where("valid").select("chain"), "chain", "left_semi").agg(
        n("case_received").alias("received"), n("provider_retry").alias("retried"), n("analysis_failed").alias("failed"),
        n("analysis_completed").alias("completed"))


@register("G5_approval_events", f"""
SELECT case_id, seq, 'case_approved' AS event, reviewer FROM ({ORACLES['G5_approve']}) WHERE outcome = 'approved'
""")
def q_g5e(spark, sf_dir):
    """Audit rows of the approvals."""
    return workflow.approval_events(q_g5(spark, sf_dir))


@register("G6_publication_events", f"""
SELECT case_id, seq, CASE outcome WHEN 'published' THEN 'case_published' WHEN 'deduplicated' THEN 'publish_deduplicated'
       ELSE 'publish_blocked' END AS event, receipt
FROM ({ORACLES['G6_publish']}) WHERE outcome <> 'error'
""")
def q_g6e(spark, sf_dir):
    """Audit rows of the publications."""
    return workflow.publication_events(q_g6(spark, sf_dir))


_ANALYSIS_EVENTS = ("analysis_deduplicated", "analysis_retried", "input_rejected", "case_received", "provider_retry",
                    "analysis_failed", "analysis_completed")


@register("J4_observed_counters", _G7_EVENTS + """
SELECT event AS name, count(*) AS count FROM ev GROUP BY event
""")
def q_j4o(spark, sf_dir):
    """The audit rows of that analysis written once, their counts taken from the same pass."""
    rows, seen = report.observed_counters(workflow.analysis_events(_logged(spark, sf_dir)), _ANALYSIS_EVENTS)
    rows.write.parquet(scratch_path(spark, "audit"))
    found = [(e, n) for e, n in seen.get.items() if n]
    return spark.createDataFrame(found, "name string, count long")
