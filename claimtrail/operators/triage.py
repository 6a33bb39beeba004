"""Classification of cases and of model logits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_line

RISKS = ("low", "medium", "high", "critical")

# The keyword tiers of the deterministic classifier, checked
# from the most to the least severe; a case with no hit is "low".
DEFAULT_KEYWORD_TIERS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("critical", ("credential leak", "remote code", "critical")),
    ("high", ("failed", "exposed", "unauthorized")),
    ("medium", ("warning", "stale", "degraded")),
)
KEYWORD_CONFIDENCE = 0.80
KEYWORD_LABEL = "synthetic-eval"
QUOTE_CHARS = 240

# Scanner severity → risk, used by the triage baseline.
SEVERITY_RISK = (("info", "low"), ("low", "low"), ("medium", "medium"),
                 ("high", "high"), ("critical", "critical"))
TRIAGE_CITATIONS = 10
# Summary and labels of the triage, which results must equal.
TRIAGE_SUMMARY = ("Deterministic triage found ", " observation(s) requiring human review.")
TRIAGE_LABEL, REVIEW_LABEL, NO_REVIEW_LABEL = "deterministic-baseline", "human-review-required", "no-review-observations"


def risk_ordinal(risk: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RISKS]), risk).cast("int") - 1


def risk_from_ordinal(o: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for r in RISKS]), o)


def _tier_ordinal(text_lower: Column, tiers) -> Column:
    expr = F.lit(0)
    # later (less severe) tiers first so the most severe hit wins
    for risk, words in reversed(tiers):
        for w in words:
            if "\n" in w or "\r" in w:
                raise ValueError("keywords may not contain line breaks")
        hit = F.lit(False)
        for w in words:
            hit = hit | text_lower.contains(w.lower())
        expr = F.when(hit, F.lit(RISKS.index(risk))).otherwise(expr)
    return expr


def keyword_classify(headers: DataFrame, sources: DataFrame,
                     tiers: Sequence[tuple[str, Sequence[str]]] = DEFAULT_KEYWORD_TIERS) -> DataFrame:
    """one assessment per case.

    The reference lower-cases the newline-joined texts and looks for each
    keyword; since no keyword holds a line break, a hit in the joined text is
    a hit in one source, so the tier is a per-case ``max`` (partial
    aggregate) and no case is ever concatenated.  The quote is the first line
    of the first source, cut to 240 code points.
    """
    per_source = sources.select(
        "case_id", "pos", "source_id",
        _tier_ordinal(F.lower("text"), tiers).alias("_tier"),
        first_line("text", QUOTE_CHARS).alias("_quote"),
    )
    agg = per_source.groupBy("case_id").agg(
        F.max("_tier").alias("_tier"),
        F.min_by(F.struct(F.col("source_id"), F.col("_quote").alias("quote")), "pos").alias("_c"),
    )
    risk = risk_from_ordinal(F.col("_tier"))
    return headers.select("case_id").join(agg, "case_id", "inner").select(
        "case_id",
        risk.alias("risk"),
        F.concat(F.lit("Evidence classified as "), risk, F.lit(" risk.")).alias("summary"),
        F.array(F.lit(KEYWORD_LABEL)).alias("labels"),
        F.array(F.col("_c")).alias("citations"),
        F.lit(KEYWORD_CONFIDENCE).alias("confidence"),
    )


def triage(headers: DataFrame, sources: DataFrame) -> DataFrame:
    """deterministic scanner triage.

    Each source text is parsed as JSON; a text that is not a JSON object counts
    as ``{"severity": "low", "status": "review"}``.  Candidates are the review
    rows, or all rows when there are none; risk is the highest candidate
    severity (unknown → medium); the first 10 candidates are cited with their
    whole text.  The top-10 picks are ``row_number() <= 10`` windows, which
    Spark turns into a group limit before the shuffle.
    """
    v = F.try_parse_json("text")
    is_obj = v.isNotNull() & F.regexp_like(F.col("text"), F.lit(r"^[ \t\n\r]*\{"))
    sev = F.when(is_obj, F.coalesce(F.try_variant_get(v, "$.severity", "string"), F.lit("None"))).otherwise(F.lit("low"))
    status = F.when(is_obj, F.coalesce(F.try_variant_get(v, "$.status", "string"), F.lit("None"))).otherwise(F.lit("review"))
    sev_map = F.create_map(*[x for kv in SEVERITY_RISK for x in (F.lit(kv[0]), F.lit(kv[1]))])
    s = sources.select(
        "case_id", "pos", "source_id", "text",
        (status == "review").alias("_review"),
        risk_ordinal(F.coalesce(F.element_at(sev_map, sev), F.lit("medium"))).alias("_ord"),
    )
    per_case = s.groupBy("case_id").agg(
        F.sum(F.col("_review").cast("int")).alias("n_review"),
        F.max(F.when(F.col("_review"), F.col("_ord"))).alias("_ord_review"),
        F.max("_ord").alias("_ord_all"),
    )
    # the first 10 sources of a case lie within the first 10 of its review
    # rows plus the first 10 of its other rows: one (case, review) window
    # whose row_number() <= 10 limit runs before the shuffle leaves at most
    # 20 rows per case, gathered into one small list
    w = Window.partitionBy("case_id", "_review").orderBy("pos")
    top = s.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= TRIAGE_CITATIONS)
    lists = top.groupBy("case_id").agg(F.array_sort(F.collect_list(
        F.struct("pos", "source_id", "text", "_review"))).alias("_top"))

    def cite(arr):
        return F.transform(F.slice(arr, 1, TRIAGE_CITATIONS),
                           lambda e: F.struct(e["source_id"].alias("source_id"), e["text"].alias("quote")))

    j = headers.select("case_id").join(per_case, "case_id", "inner").join(lists, "case_id", "left")
    has_review = F.col("n_review") > 0
    ordv = F.when(has_review, F.col("_ord_review")).otherwise(F.col("_ord_all"))
    return j.select(
        "case_id",
        risk_from_ordinal(F.coalesce(ordv, F.lit(0))).alias("risk"),
        F.concat(F.lit(TRIAGE_SUMMARY[0]), F.col("n_review").cast("string"), F.lit(TRIAGE_SUMMARY[1])).alias("summary"),
        F.array(F.lit(TRIAGE_LABEL), F.when(has_review, F.lit(REVIEW_LABEL)).otherwise(F.lit(NO_REVIEW_LABEL))).alias("labels"),
        F.when(has_review, cite(F.filter("_top", lambda e: e["_review"]))).otherwise(cite(F.col("_top"))).alias("citations"),
        F.lit(1.0).alias("confidence"),
        F.col("n_review").cast("bigint").alias("n_review"),
    )


def constrained_classify(df: DataFrame, logits: str, token_groups: Sequence[Sequence[int]],
                         class_names: Sequence[str]) -> DataFrame:
    """per class the max logit over its token variants (0-based ids),
    softmax over the classes only, argmax (first max wins), and whether the
    unrestricted top token is one of the class tokens."""
    lg = F.transform(F.col(logits), lambda x: x.cast("double"))
    groups = F.array(*[F.array(*[F.lit(int(i)) for i in g]) for g in token_groups])
    cls = F.transform(groups, lambda g: F.array_max(F.transform(g, lambda i: F.element_at(lg, i + 1))))
    out = df.withColumn("_cls", cls)
    mx = F.array_max("_cls")
    exps = F.transform("_cls", lambda x: F.exp(x - mx))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    probs = F.transform(exps, lambda x: x / total)
    out = out.withColumn("probs", probs)
    k = F.array_position("_cls", mx)  # 1-based, first max
    names = F.array(*[F.lit(n) for n in class_names])
    all_ids = sorted({int(i) for g in token_groups for i in g})
    top_id = F.array_position(lg, F.array_max(lg)) - 1
    return out.select(
        "*",
        F.element_at(names, k.cast("int")).alias("pred"),
        F.element_at("probs", k.cast("int")).alias("confidence"),
        top_id.cast("bigint").alias("free_top_token"),
        F.array_contains(F.array(*[F.lit(i).cast("bigint") for i in all_ids]), top_id.cast("bigint")).alias("free_top_is_class"),
    ).drop("_cls")


def case_payloads(headers: DataFrame, sources: DataFrame, max_chars: int = 100_000) -> DataFrame:
    """Per case the JSON payload a model receives: ``{"title": ...,
    "sources": [{"source_id": ..., "text": ...}, ...]}`` in source order.

    Every case has a row ``(case_id, payload, reason)``: a case over the input
    size cap, or without sources, has no payload but the reason rule E1 would
    give.  Only cases within the cap are rendered, so the per-case list is
    bounded by ``max_chars`` characters of text."""
    from .validate import MSG_NO_SOURCES, MSG_TOO_LARGE
    size = sources.groupBy("case_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("_chars"))
    src = sources.join(size.where(F.col("_chars") <= F.lit(max_chars)).select("case_id"), "case_id", "left_semi")
    lists = src.groupBy("case_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "source_id", "text"))),
        lambda e: F.struct(e["source_id"].alias("source_id"), e["text"].alias("text"))).alias("_s"))
    j = headers.join(size, "case_id", "left").join(lists, "case_id", "left")
    reason = F.when(F.col("_chars").isNull(), F.lit(MSG_NO_SOURCES)).when(F.col("_chars") > F.lit(max_chars), F.lit(MSG_TOO_LARGE))
    return j.select("case_id", F.when(reason.isNull(), F.to_json(F.struct(F.col("title"), F.col("_s").alias("sources"))))
                    .alias("payload"), reason.alias("reason"))


def model_classify(headers: DataFrame, sources: DataFrame, predict, max_chars: int = 100_000,
                   attempt: int = 1, chunk: int = 64) -> DataFrame:
    """Plug-in surface for a user's model: ``predict(payloads: pd.Series) ->
    pd.Series`` of answer texts is called inside the tasks (``mapInPandas``)
    on chunks of at most ``chunk`` case payloads (each payload is at most
    ``max_chars`` of text, so a call's input is bounded), and the answers are
    parsed strictly (E2).  Returns (case_id, attempt, content, input_reason,
    assessment columns, parse_ok), a row for every case: one that has no payload
    is not asked and carries ``input_reason``.  Chain with
    ``validate.first_valid_attempt`` for repairs."""
    import pandas as pd

    from .validate import parse_assessments

    payloads = case_payloads(headers, sources, max_chars)

    def run(it):
        for pdf in it:
            for start in range(0, len(pdf), chunk):
                part = pdf.iloc[start:start + chunk].reset_index(drop=True)
                asked = part["payload"].notna()
                content = pd.Series([None] * len(part), dtype=object)
                if asked.any():
                    content[asked.to_numpy()] = list(predict(part.loc[asked, "payload"].reset_index(drop=True)))
                yield pd.DataFrame({"case_id": part["case_id"], "attempt": attempt, "content": content,
                                    "input_reason": part["reason"]})

    responses = payloads.mapInPandas(run, "case_id string, attempt int, content string, input_reason string")
    return parse_assessments(responses)
