"""Registered queries, group B (chain): B1_case_fingerprint, B1_record_fingerprint, B2_idempotency_key, B3_chain_append, B4_chain_verify, B5_chain_tail, B6_canonical_json."""

from ._shared import *  # noqa: F401,F403
from ._shared import register  # noqa: F401


@register("B1_case_fingerprint", f"""
WITH {O.CONV_SOURCES},
  leaf AS (SELECT case_id, pos, sha256({O.canon('source_id')} || {O.canon('text')}) AS leaf FROM src),
  {O.merkle('leaf', 'case_id', 'pos', 'leaf')},
  n AS (SELECT case_id, count(*) AS n FROM src GROUP BY case_id)
SELECT hdr.case_id, sha256({O.canon('hdr.case_id')} || {O.canon('hdr.title')} || {O.canon('n.n')} || mtop.tree)
         AS fingerprint
FROM hdr JOIN n USING (case_id) JOIN mtop USING (case_id)
""")
def q_b1(spark, sf_dir):
    headers, sources = fixtures.conversation_cases(spark, sf_dir)
    return hashing.case_fingerprints(headers, sources)


@register("B1_record_fingerprint", f"""
SELECT doc_id, sha256({O.canon('lang')} || {O.canon('source')} || {O.canon('text')}) AS fingerprint FROM documents
""")
def q_b1r(spark, sf_dir):
    d = fixtures.table(spark, sf_dir, "documents")
    return d.select("doc_id", hashing.fingerprint("lang", "source", "text").alias("fingerprint"))


@register("B2_idempotency_key", """
SELECT 'user-' || CAST(user_id AS VARCHAR) AS case_id,
       sha256('case:' || CAST(user_id AS VARCHAR)) || ':' || sha256('assessment:' || CAST(user_id AS VARCHAR))
         AS idempotency_key
FROM (SELECT DISTINCT user_id FROM events)
""")
def q_b2(spark, sf_dir):
    st = fixtures.state_snapshot(spark, sf_dir)
    return st.select("case_id", hashing.idempotency_key("case_fingerprint", "assessment_fp").alias("idempotency_key"))


@register("B3_chain_append", f"""
WITH RECURSIVE {O.AUDIT}
SELECT chain, seq, prev AS previous_hash, h AS event_hash FROM chainh
""")
def q_b3(spark, sf_dir):
    out = chainops.chain_append(fixtures.audit_events(spark, sf_dir))
    return out.select("chain", "seq", "previous_hash", "event_hash")


@register("B4_chain_verify", f"""
WITH RECURSIVE {O.AUDIT},
  tam AS (SELECT a.chain, a.seq, a.rn,
                 CASE WHEN a.{_TAMPER} THEN 'tampered' ELSE a.event END AS event, a.case_id, a.props, a.ts_us,
                 ch.prev, ch.h FROM aud a JOIN chainh ch USING (chain, rn)),
  chk AS (SELECT *, sha256({O.record_canon_sql()} || '64:' || prev) = h AS self_ok,
                 prev = coalesce(lag(h) OVER (PARTITION BY chain ORDER BY seq), repeat('0', 64)) AS link_ok
          FROM tam)
SELECT chain, bool_and(self_ok AND link_ok) AS valid, min(CASE WHEN NOT (self_ok AND link_ok) THEN seq END)
         AS first_bad_seq, count(*) AS n
FROM chk GROUP BY chain
""")
def q_b4(spark, sf_dir):
    audit = chainops.chain_append(fixtures.audit_events(spark, sf_dir))
    tampered = audit.withColumn("event", F.when(F.expr(_TAMPER), F.lit("tampered")).otherwise(F.col("event")))
    return chainops.chain_verify(tampered).select("chain", "valid", "first_bad_seq",
                                                  F.col("n").cast("bigint").alias("n"))


@register("B5_chain_tail", f"""
WITH RECURSIVE {O.AUDIT}
SELECT chain, max(seq) AS last_seq, arg_max(h, seq) AS tail_hash FROM chainh GROUP BY chain
""")
def q_b5(spark, sf_dir):
    return chainops.chain_tail(chainops.chain_append(fixtures.audit_events(spark, sf_dir)))


@register("B6_canonical_json", """
SELECT event_id, CAST(json(props) AS VARCHAR) AS canonical FROM events
""")
def q_b6(spark, sf_dir):
    """Canonical (sorted, compact) JSON of every event's property text."""
    ev = fixtures.table(spark, sf_dir, "events")
    return ev.select("event_id", chainops.canonical_json("props").alias("canonical"))
