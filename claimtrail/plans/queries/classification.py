"""Registered queries, group F (classification): F1_keyword_classify, F1_keyword_classify_default, F3_constrained_classify, F2_triage."""

from ._shared import *  # noqa: F401,F403
from ._shared import register  # noqa: F401


@register("F1_keyword_classify", f"""
WITH {O.CONV_SOURCES},
  cls AS (SELECT case_id, max({O.tier_case(fixtures.CONVERSATION_TIERS)}) AS tier,
                 arg_min(source_id, pos) AS sid, arg_min({O.first_line('text')}, pos) AS quote
          FROM src GROUP BY case_id)
SELECT case_id, {O.RISK_NAME.format(x='tier')} AS risk,
       'Evidence classified as ' || {O.RISK_NAME.format(x='tier')} || ' risk.' AS summary,
       sid AS citation_source, quote, 0.8::DOUBLE AS confidence
FROM cls
""")
def q_f1(spark, sf_dir):
    headers, sources = fixtures.conversation_cases(spark, sf_dir)
    a = triage.keyword_classify(headers, sources, fixtures.CONVERSATION_TIERS)
    return a.select("case_id", "risk", "summary",
                    F.col("citations")[0]["source_id"].alias("citation_source"),
                    F.col("citations")[0]["quote"].alias("quote"), "confidence")


@register("F1_keyword_classify_default", """
SELECT CAST(doc_id AS VARCHAR) AS case_id,
       CASE WHEN contains(lower(text), 'credential leak') OR contains(lower(text), 'remote code')
                 OR contains(lower(text), 'critical') THEN 'critical'
            WHEN contains(lower(text), 'failed') OR contains(lower(text), 'exposed')
                 OR contains(lower(text), 'unauthorized') THEN 'high'
            WHEN contains(lower(text), 'warning') OR contains(lower(text), 'stale')
                 OR contains(lower(text), 'degraded') THEN 'medium' ELSE 'low' END AS risk
FROM documents
""")
def q_f1_default(spark, sf_dir):
    headers, sources, _ = fixtures.document_cases(spark, sf_dir)
    return triage.keyword_classify(headers, sources).select("case_id", "risk")


@register("F3_constrained_classify", f"""
WITH {_f3_sql(0)}
SELECT key, label, pred, round(confidence, 6) AS confidence, correct, free_top_is_letter FROM preds
""")
def q_f3(spark, sf_dir):
    return fixtures.predictions(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@register("F2_triage", f"""
WITH {O.OBS}, {O.REPORTS}, {O.selected()}, {_SUMMARY_SQL}, {_TRIAGE_SQL}
SELECT case_id, risk, n_review, n_citations, first_citation FROM tri
""")
def q_f2(spark, sf_dir):
    """Triage of the per-repository cases (selected observations plus the
    selection summary)."""
    _, _, t = _triage_by_repo(spark, sf_dir)
    return t.select("case_id", "risk", "n_review", F.size("citations").cast("bigint").alias("n_citations"),
                    F.col("citations")[0]["source_id"].alias("first_citation"))


def _tier_model(payloads):
    """A deterministic stand-in for a user's model (pandas in, pandas out):
    the conversation keyword tiers over the case payload, citing the first
    line of the first source."""
    import json

    import pandas as pd
    order = {"low": 0, "medium": 1, "high": 2, "critical": 3}
    out = []
    for p in payloads:
        case = json.loads(p)
        texts = [s["text"].lower() for s in case["sources"]]
        risk = "low"
        for name, words in fixtures.CONVERSATION_TIERS:
            if any(w in t for w in words for t in texts) and order[name] > order[risk]:
                risk = name
        first = case["sources"][0]
        lines = first["text"].splitlines()
        out.append(json.dumps({"risk": risk, "summary": f"Model classified the case as {risk}.",
                               "labels": ["plug-in"],
                               "citations": [{"source_id": first["source_id"], "quote": (lines[0] if lines else "")[:240]}],
                               "confidence": 0.75}))
    return pd.Series(out)


@register("F1_model_classify", f"""
WITH {O.CONV_SOURCES},
  cls AS (SELECT case_id, max({O.tier_case(fixtures.CONVERSATION_TIERS)}) AS tier,
                 arg_min(source_id, pos) AS sid, arg_min({O.first_line('text')}, pos) AS quote
          FROM src GROUP BY case_id)
SELECT case_id, {O.RISK_NAME.format(x='tier')} AS risk, true AS parse_ok, sid AS citation_source, quote,
       0.75::DOUBLE AS confidence
FROM cls
""")
def q_f1m(spark, sf_dir):
    """The model plug-in surface (mapInPandas over case payloads) with a
    deterministic stand-in model, parsed strictly (E2)."""
    headers, sources = fixtures.conversation_cases(spark, sf_dir)
    a = triage.model_classify(headers, sources, _tier_model)
    return a.select("case_id", "risk", "parse_ok", F.col("citations")[0]["source_id"].alias("citation_source"),
                    F.col("citations")[0]["quote"].alias("quote"), "confidence")
