"""Registered queries, group E (validation): E1_validate_cases, E1_validate_cases_size, E2_parse_assessments, E3_first_valid_attempt, E6_prohibited_claims, E5_ground_citations, E4_validate_assessments, E7_passage_overlap."""

from ._shared import *  # noqa: F401,F403
from ._shared import register  # noqa: F401


@register("E1_validate_cases", f"""
WITH {O.CONV_ROLE_SOURCES}, {O.e1_reason()}
SELECT case_id, reason FROM e1
""")
def q_e1(spark, sf_dir):
    headers, sources = fixtures.conversation_cases(spark, sf_dir, source_id="role")
    return validate.validate_cases(headers, sources)


@register("E1_validate_cases_size", f"""
WITH {O.CONV_SOURCES}, {O.e1_reason(2000)}
SELECT case_id, reason FROM e1
""")
def q_e1_size(spark, sf_dir):
    headers, sources = fixtures.conversation_cases(spark, sf_dir)
    return validate.validate_cases(headers, sources, max_chars=2000)


@register("E2_parse_assessments", f"""
WITH {_RESP_SQL}
SELECT case_id, attempt, parse_ok, risk, summary, n_citations, confidence FROM parsed
""")
def q_e2(spark, sf_dir):
    p = validate.parse_assessments(fixtures.responses(spark, sf_dir))
    return p.select("case_id", "attempt", "parse_ok", "risk", "summary",
                    F.coalesce(F.size("citations"), F.lit(0)).cast("int").alias("n_citations"), "confidence")


@register("E3_first_valid_attempt", f"""
WITH {_RESP_SQL},
  v AS (SELECT *, CASE WHEN NOT parse_ok THEN 'provider returned an invalid assessment'
                       WHEN {_banned_sql('labels', 'summary')} IS NOT NULL
                         THEN 'provider returned prohibited assurance semantics' END AS err
        FROM parsed WHERE attempt <= 2),
  a AS (SELECT case_id, min(CASE WHEN err IS NULL THEN attempt END) AS acc, max(attempt) AS last,
               arg_max(err, attempt) AS last_err FROM v GROUP BY case_id)
SELECT a.case_id, a.acc AS accepted_attempt, coalesce(a.acc, a.last) AS attempts_used,
       CASE WHEN a.acc IS NULL THEN a.last_err END AS reason, v.risk
FROM a LEFT JOIN v ON v.case_id = a.case_id AND v.attempt = a.acc
""")
def q_e3(spark, sf_dir):
    p = validate.parse_assessments(fixtures.responses(spark, sf_dir))
    out = validate.first_valid_attempt(p, lambda d: validate.prohibited_claims_reason(), max_repairs=1)
    return out.select("case_id", "accepted_attempt", "attempts_used", "reason", "risk")


@register("E6_prohibited_claims", f"""
WITH {_RESP_SQL}
SELECT case_id, attempt, {_banned_sql('labels', 'summary')} AS reason FROM parsed WHERE parse_ok
""")
def q_e6(spark, sf_dir):
    p = validate.parse_assessments(fixtures.responses(spark, sf_dir)).where("parse_ok")
    return p.select("case_id", "attempt", validate.prohibited_claims_reason().alias("reason"))


@register("E5_ground_citations", f"""
WITH {_CITES}, {O.CONV_SOURCES}
SELECT cit.case_id, cit.cpos, cit.source_id,
       CASE WHEN src.text IS NULL THEN 'unknown_source'
            WHEN {O.blank('cit.quote')} OR NOT contains(src.text, cit.quote) THEN 'unresolved' ELSE 'ok' END AS status,
       CASE WHEN src.text IS NULL THEN 'unknown citation source: ' || cit.source_id
            WHEN {O.blank('cit.quote')} OR NOT contains(src.text, cit.quote)
              THEN 'citation quote does not resolve in source: ' || cit.source_id END AS reason
FROM cit LEFT JOIN src ON src.case_id = cit.case_id AND src.source_id = cit.source_id
""")
def q_e5(spark, sf_dir):
    c = fixtures.table(spark, sf_dir, "conversations")
    cites = c.select(
        F.col("conv_id").cast("string").alias("case_id"), F.col("turn").alias("cpos"),
        F.when(F.col("turn") % 3 == 0, F.col("turn").cast("string")).when(F.col("turn") % 3 == 1, F.lit("99"))
        .otherwise((F.col("turn") - 1).cast("string")).alias("source_id"),
        F.substring("text", 3, 25).alias("quote"))
    _, sources = fixtures.conversation_cases(spark, sf_dir)
    return validate.ground_citations(cites, sources)


@register("E4_validate_assessments", f"""
WITH {O.CONV_SOURCES},
  a AS (SELECT CAST(conv_id AS VARCHAR) AS case_id,
               CASE WHEN conv_id % 10 = 0 THEN '  ' ELSE 'summary ' || CAST(conv_id AS VARCHAR) END AS summary,
               CASE WHEN conv_id % 7 = 0 THEN 1.5 ELSE 0.5 END::DOUBLE AS confidence FROM conversations
        WHERE turn = 0),
  c AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, turn AS cpos,
               CASE WHEN turn = 1 AND conv_id % 4 = 0 THEN '42' ELSE CAST(turn AS VARCHAR) END AS source_id,
               CASE WHEN turn = 1 AND conv_id % 3 = 0 THEN 'nope' ELSE substring(text, 10, 20) END AS quote
        FROM conversations),
  g AS (SELECT c.case_id, c.cpos,
               CASE WHEN src.text IS NULL THEN 'unknown citation source: ' || c.source_id
                    WHEN {O.blank('c.quote')} OR NOT contains(src.text, c.quote)
                      THEN 'citation quote does not resolve in source: ' || c.source_id END AS reason
        FROM c LEFT JOIN src ON src.case_id = c.case_id AND src.source_id = c.source_id),
  fb AS (SELECT case_id, arg_min(reason, cpos) AS cr FROM g WHERE reason IS NOT NULL GROUP BY case_id)
SELECT a.case_id,
       CASE WHEN {O.blank('a.summary')} THEN 'assessment summary is required'
            WHEN a.confidence < 0 OR a.confidence > 1 THEN 'confidence must be between 0 and 1'
            ELSE fb.cr END AS reason
FROM a LEFT JOIN fb USING (case_id)
""")
def q_e4(spark, sf_dir):
    c = fixtures.table(spark, sf_dir, "conversations")
    cit = c.select(
        F.col("conv_id").cast("string").alias("case_id"), F.col("turn"),
        F.struct(
            F.when((F.col("turn") == 1) & (F.col("conv_id") % 4 == 0), F.lit("42"))
            .otherwise(F.col("turn").cast("string")).alias("source_id"),
            F.when((F.col("turn") == 1) & (F.col("conv_id") % 3 == 0), F.lit("nope"))
            .otherwise(F.substring("text", 10, 20)).alias("quote")).alias("c"))
    cites = cit.groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "c"))), lambda e: e["c"]).alias("citations"))
    heads = c.where(F.col("turn") == 0).select(
        F.col("conv_id").cast("string").alias("case_id"),
        F.when(F.col("conv_id") % 10 == 0, F.lit("  ")).otherwise(
            F.concat(F.lit("summary "), F.col("conv_id").cast("string"))).alias("summary"),
        F.when(F.col("conv_id") % 7 == 0, F.lit(1.5)).otherwise(F.lit(0.5)).alias("confidence"))
    _, sources = fixtures.conversation_cases(spark, sf_dir)
    return validate.validate_assessments(heads.join(cites, "case_id"), sources)


@register("E7_passage_overlap", """
SELECT b.item_id AS passage_id, d.doc_id AS text_id
FROM benchmark b JOIN documents d ON contains(d.text, b.text)
""")
def q_e7(spark, sf_dir):
    b = fixtures.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"),
                                                         F.col("text").alias("passage"))
    d = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return validate.passage_overlap(b, d)
