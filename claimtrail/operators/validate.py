"""Input rules, model-output parsing, grounding and banned claims.

Cases are kept in long form: ``headers(case_id, title)`` and
``sources(case_id, pos, source_id, text)``; an assessment is
``(case_id, risk, summary, labels array<string>, citations
array<struct<source_id,quote>>, confidence double)``.  Every rule is a
per-row expression or a per-case partial aggregate, so a case with very many
sources is never gathered into one row.  Invalid rows get a ``reason``; no
exception is raised for data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse_ws, is_blank, py_strip

MAX_SOURCE_CHARS = 100_000
RISKS = ("low", "medium", "high", "critical")

# Messages of the input and assessment rules.
MSG_CASE_ID = "case_id is required"
MSG_TITLE = "title is required"
MSG_NO_SOURCES = "at least one evidence source is required"
MSG_SOURCE_ID = "source_id is required"
MSG_UNIQUE = "source_id values must be unique"
MSG_EMPTY_TEXT = "evidence text cannot be empty"
MSG_TOO_LARGE = "evidence exceeds the configured size limit"
MSG_SUMMARY = "assessment summary is required"
MSG_CONFIDENCE = "confidence must be between 0 and 1"
MSG_NO_CITATION = "at least one grounded citation is required"
MSG_UNKNOWN_SOURCE = "unknown citation source: "
MSG_UNRESOLVED = "citation quote does not resolve in source: "
MSG_BANNED_LABEL = "assessment contains a prohibited assurance label"
MSG_BANNED_CLAIM = "assessment contains a prohibited assurance claim"
MSG_INVALID_OUTPUT = "provider returned an invalid assessment"
MSG_BANNED_OUTPUT = "provider returned prohibited assurance semantics"

# Labels and summary phrases an assurance assessment may not use.
PROHIBITED_LABELS = (
    "compliance", "compliant", "certified", "certification",
    "fully-secure", "no-vulnerabilities",
)
PROHIBITED_PHRASES = (
    "strong compliance", "is compliant", "are compliant", "compliance confirmed",
    "compliance achieved", "fully secure", "no vulnerabilities",
    "all vulnerabilities", "certification achieved",
)

CITATION = T.StructType([T.StructField("source_id", T.StringType()),
                         T.StructField("quote", T.StringType())])


def first_failing(*rules: tuple[Column, str | Column]) -> Column:
    """Ordered ``coalesce(when …)``: the message of the first rule that fails."""
    return F.coalesce(*[F.when(cond, msg if isinstance(msg, Column) else F.lit(msg))
                        for cond, msg in rules])


# ---------------------------------------------------------------- E1
def source_stats(sources: DataFrame) -> DataFrame:
    """Per-case aggregates the input rules need (all partial aggregates)."""
    return sources.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.count_distinct("source_id").alias("n_distinct_ids"),
        F.max(is_blank("source_id").cast("int")).alias("any_blank_id"),
        F.max(is_blank("text").cast("int")).alias("any_blank_text"),
        F.sum(F.length("text")).cast("bigint").alias("total_chars"),
    )


def validate_cases(headers: DataFrame, sources: DataFrame,
                   max_chars: int = MAX_SOURCE_CHARS) -> DataFrame:
    """(case_id, reason); reason is null for a valid case."""
    stats = source_stats(sources)
    n = F.coalesce(F.col("n_sources"), F.lit(0))
    reason = first_failing(
        (is_blank("case_id"), MSG_CASE_ID),
        (is_blank("title"), MSG_TITLE),
        (n == 0, MSG_NO_SOURCES),
        (F.col("any_blank_id") == 1, MSG_SOURCE_ID),
        (F.col("n_distinct_ids") != n, MSG_UNIQUE),
        (F.col("any_blank_text") == 1, MSG_EMPTY_TEXT),
        (F.col("total_chars") > F.lit(max_chars), MSG_TOO_LARGE),
    )
    return headers.join(stats, "case_id", "left").select("case_id", reason.alias("reason"))


# ---------------------------------------------------------------- E2
_PARSE_SCHEMA = T.StructType([
    T.StructField("risk", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("citations", T.ArrayType(CITATION)),
    T.StructField("confidence", T.StringType()),
])


def parse_assessments(responses: DataFrame, content: str = "content") -> DataFrame:
    """Strict parse of model output text: one JSON object and nothing else.

    Adds the assessment columns plus ``parse_ok``.  The text must parse both as
    the only element of an array and as the only member of an object, which
    trailing text, a second object or a stray bracket cannot do; single quotes
    are refused.  ``confidence`` is read as text and cast with ``try_cast`` (a
    quoted number is accepted, as the reference's ``float()`` does); a JSON null
    counts as absent.  A string for ``labels`` counts as its characters, as a
    sequence; any other scalar fails.
    """
    options = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}
    text = F.col(content)
    one = T.StructType([*_PARSE_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    as_text = T.StructType([T.StructField("labels", T.StringType())])
    shape = T.StructType([T.StructField("x", T.MapType(T.StringType(), T.StringType())), T.StructField("_bad", T.StringType())])
    alone = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(T.MapType(T.StringType(), T.StringType())), options)
    member = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), shape, options)
    strict = (F.regexp_like(text, F.lit(r"^[ \t\n\r]*\{")) & (F.size(alone) == 1) & alone[0].isNotNull()
              & member["x"].isNotNull() & member["_bad"].isNull())
    loose = F.from_json(text, as_text, options)["labels"]
    out = responses.withColumns({"_p": F.from_json(text, one, options), "_l": loose, "_s": F.coalesce(strict, F.lit(False))})
    spelled = F.col("_p.labels").isNull() & F.col("_l").isNotNull()
    string_value = spelled & F.regexp_like(text, F.lit(r'"labels"[ \t\n\r]*:[ \t\n\r]*"'))
    out = out.select(
        "*",
        F.col("_p.risk").alias("risk"),
        F.col("_p.summary").alias("summary"),
        F.when(string_value, F.filter(F.split("_l", ""), lambda x: x != ""))
        .otherwise(F.coalesce(F.col("_p.labels"), F.array().cast("array<string>"))).alias("labels"),
        F.col("_p.citations").alias("citations"),
        F.col("_p.confidence").try_cast("double").alias("confidence"),
        (F.col("_s") & (~spelled | string_value)).alias("_ok"),
    ).drop("_p", "_l", "_s")
    ok = (
        F.col("_ok")
        & F.col("risk").isin(*RISKS)
        & F.col("summary").isNotNull()
        & F.col("citations").isNotNull()
        & ~F.exists("citations", lambda c: c.isNull() | c["source_id"].isNull() | c["quote"].isNull())
        & ~F.exists("labels", lambda x: x.isNull())
        & F.col("confidence").isNotNull()
    )
    return out.withColumn("parse_ok", F.coalesce(ok, F.lit(False))).drop("_ok")


# ---------------------------------------------------------------- E3
def first_valid_attempt(parsed: DataFrame, validator: Callable[[DataFrame], Column] | None = None,
                        max_repairs: int = 1) -> DataFrame:
    """Per case the first attempt (1-based) that parses and passes
    ``validator`` (a function returning a reason column, null = pass) within
    ``1 + max_repairs`` attempts; otherwise the failure kind of the last one.

    Output: case_id, accepted_attempt, attempts_used, reason (null = accepted),
    and the accepted assessment columns.
    """
    v = parsed.where(F.col("attempt") <= F.lit(1 + max_repairs))
    vreason = validator(v) if validator is not None else F.lit(None).cast("string")
    v = v.withColumn(
        "_err",
        F.when(~F.col("parse_ok"), F.lit(MSG_INVALID_OUTPUT))
        .when(vreason.isNotNull(), F.lit(MSG_BANNED_OUTPUT)),
    )
    good = F.struct("attempt", "risk", "summary", "labels", "citations", "confidence")
    agg = v.groupBy("case_id").agg(
        F.min(F.when(F.col("_err").isNull(), F.col("attempt"))).alias("accepted_attempt"),
        F.min_by(F.when(F.col("_err").isNull(), good),
                 F.when(F.col("_err").isNull(), F.col("attempt"))).alias("_a"),
        F.max("attempt").alias("_last"),
        F.max_by("_err", "attempt").alias("_last_err"),
    )
    return agg.select(
        "case_id",
        F.col("accepted_attempt").cast("bigint").alias("accepted_attempt"),
        F.coalesce("accepted_attempt", "_last").cast("bigint").alias("attempts_used"),
        F.when(F.col("accepted_attempt").isNull(), F.col("_last_err")).alias("reason"),
        F.col("_a.risk").alias("risk"), F.col("_a.summary").alias("summary"),
        F.col("_a.labels").alias("labels"), F.col("_a.citations").alias("citations"),
        F.col("_a.confidence").alias("confidence"),
    )


# ---------------------------------------------------------------- E5
def explode_citations(assessments: DataFrame) -> DataFrame:
    return assessments.select(
        "case_id", F.posexplode("citations").alias("cpos", "c")
    ).select("case_id", "cpos", F.col("c.source_id").alias("source_id"),
             F.col("c.quote").alias("quote"))


def ground_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """E5: per citation ``(case_id, cpos, source_id, status, reason)``;
    status ``ok`` / ``unknown_source`` / ``unresolved``.

    One plan for every size: a left equi-join on (case_id, source_id), which
    AQE broadcasts when a side is measured small and splits when a case is hot.
    A source id that a case repeats (rule E1 refuses it) grounds a citation if
    any of its texts holds the quote, so no citation multiplies.
    """
    c = citations.select("case_id", "cpos", "source_id", "quote")
    if c.isStreaming:       # no aggregate over the stream: the static side has one row for an id instead
        s = sources.groupBy("case_id", "source_id").agg(F.collect_set("text").alias("_texts"))
        j = c.join(s, ["case_id", "source_id"], "left")
        held = F.coalesce(F.exists("_texts", lambda t: t.contains(F.col("quote"))), F.lit(False))
        rank = F.when(F.col("_texts").isNull(), 0).when(is_blank("quote") | ~held, 1).otherwise(2)
        j = j.select("case_id", "cpos", "source_id", rank.alias("_rank"))
    else:
        s = sources.select("case_id", "source_id", F.col("text").alias("_text"), F.lit(True).alias("_known"))
        unresolved = is_blank("quote") | ~F.coalesce(F.col("_text").contains(F.col("quote")), F.lit(False))
        rank = F.when(F.col("_known").isNull(), 0).when(unresolved, 1).otherwise(2)
        j = c.join(s, ["case_id", "source_id"], "left").select("case_id", "cpos", "source_id", rank.alias("_rank"))
        j = j.groupBy("case_id", "cpos", "source_id").agg(F.max("_rank").alias("_rank"))
    names = F.array(F.lit("unknown_source"), F.lit("unresolved"), F.lit("ok"))
    j = j.select("case_id", "cpos", "source_id", F.element_at(names, F.col("_rank") + 1).alias("status"))
    reason = (
        F.when(F.col("status") == "unknown_source",
               F.concat(F.lit(MSG_UNKNOWN_SOURCE), F.coalesce("source_id", F.lit("None"))))
        .when(F.col("status") == "unresolved",
              F.concat(F.lit(MSG_UNRESOLVED), F.coalesce("source_id", F.lit("None"))))
    )
    return j.select("case_id", "cpos", "source_id", "status", reason.alias("reason"))


def first_bad_citation(grounded: DataFrame) -> DataFrame:
    """(case_id, reason) of the first failing citation by position."""
    bad = grounded.where(F.col("status") != "ok")
    return bad.groupBy("case_id").agg(F.min_by("reason", "cpos").alias("citation_reason"))


# ---------------------------------------------------------------- E4
def validate_assessments(assessments: DataFrame, sources: DataFrame) -> DataFrame:
    """E4 (+E5): (case_id, reason) — summary, confidence range, at least one
    citation, then the first citation that does not resolve."""
    grounded = first_bad_citation(ground_citations(explode_citations(assessments), sources))
    j = assessments.join(grounded, "case_id", "left")
    conf = F.col("confidence")
    reason = first_failing(
        (is_blank("summary"), MSG_SUMMARY),
        (conf.isNull() | F.isnan(conf) | (conf < 0.0) | (conf > 1.0), MSG_CONFIDENCE),
        (F.coalesce(F.size("citations"), F.lit(0)) <= 0, MSG_NO_CITATION),
        (F.col("citation_reason").isNotNull(), F.col("citation_reason")),
    )
    return j.select("case_id", reason.alias("reason"))


# ---------------------------------------------------------------- E6
def prohibited_claims_reason(labels="labels", summary="summary",
                             banned_labels: Sequence[str] = PROHIBITED_LABELS,
                             banned_phrases: Sequence[str] = PROHIBITED_PHRASES) -> Column:
    lab = F.col(labels) if isinstance(labels, str) else labels
    summ = F.col(summary) if isinstance(summary, str) else summary
    norm = F.transform(F.coalesce(lab, F.array().cast("array<string>")), lambda x: F.lower(py_strip(x)))
    banned = F.array(*[F.lit(w) for w in banned_labels])
    text = F.lower(collapse_ws(summ))
    phrase_hit = F.exists(F.array(*[F.lit(p) for p in banned_phrases]), lambda p: text.contains(p))
    return first_failing(
        (F.arrays_overlap(norm, banned), MSG_BANNED_LABEL),
        (F.coalesce(phrase_hit, F.lit(False)), MSG_BANNED_CLAIM),
    )


def prohibited_claims(assessments: DataFrame, **kw) -> DataFrame:
    """(case_id, reason)."""
    return assessments.select("case_id", prohibited_claims_reason(**kw).alias("reason"))


# ---------------------------------------------------------------- E7
def passage_overlap(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """All (passage_id, text_id) where the passage occurs verbatim in the
    text.  ``passages(passage_id, passage)``, ``texts(text_id, text)``.  One exact
    equi-join on whole keys for every number and length of passages."""
    from ..functions.substring import containing
    return containing(texts, "text_id", "text", passages, "passage_id", "passage")
