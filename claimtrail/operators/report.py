"""Pilot metrics, summaries, evidence packs, telemetry and text
tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.rank import global_rank, rank_within

FENCE = "```"
FENCE_NEUTRAL = "` ` `"

# Workflow audit event names used by the SLI report.
EV_RECEIVED = "case_received"
EV_COMPLETED = "analysis_completed"
EV_FAILED = "analysis_failed"
EV_RETRY = "provider_retry"
EV_INPUT_REJECTED = "input_rejected"
EV_APPROVED = "case_approved"
EV_PUBLISHED = "case_published"
EV_PUBLISH_DEDUP = "publish_deduplicated"


def sorted_counts(df: DataFrame, key: Sequence[str], col: str, out: str) -> DataFrame:
    """Per key a ``name=count`` text sorted by name (the sorted map of the
    reference), built from a two-level aggregate: only the distinct names of
    one key are gathered, never its rows."""
    c = df.groupBy(*key, col).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(col).alias("k"), F.col("_n").alias("v")))),
        lambda e: F.concat(e["k"], F.lit("="), e["v"].cast("string"))), ",").alias(out))


# ---------------------------------------------------------------- J1
def _tally(pairs: str, field: str) -> Column:
    """``name=count`` by name from an array of (status, severity, n) tallies."""
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p[field])))
    return F.array_join(F.transform(names, lambda name: F.concat(
        name, F.lit("="), F.aggregate(F.filter(pairs, lambda p: p[field] == name), F.lit(0).cast("bigint"),
                                      lambda n, p: n + p["n"]).cast("string"))), ",")


def pilot_metrics(reports: DataFrame, observations: DataFrame, assessments: DataFrame, executions: DataFrame,
                  audit: DataFrame | None = None, durations: DataFrame | None = None,
                  key: Sequence[str] = ("engagement_id", "repository_id")) -> DataFrame:
    """One row for every report, also an empty one: fingerprint, observation
    tallies, the assessment's figures, scanner executions, whether all were
    network isolated (true without any), the audit chain's check (null: not
    checked), the provider's duration, and what the figures do not claim.

    ``audit(key, valid)`` and ``durations(key, duration_ms)`` are optional.  The
    observations are aggregated once, by (key, status, severity); only these few
    tallies of a report meet in one row.
    """
    from .evidence import OBS_FIELDS, report_fingerprints
    from ..functions.hashing import canon_record
    key = list(key)
    pairs = (observations.groupBy(*key, "status", "severity").agg(F.count(F.lit(1)).alias("n"))
             .groupBy(*key).agg(F.collect_list(F.struct("status", "severity", "n")).alias("_p")))
    out = reports.select(*key).join(pairs, key, "left")
    if set(OBS_FIELDS) | {"pos"} <= set(observations.columns):
        out = out.join(report_fingerprints(observations, key), key, "left").withColumn(
            "report_fp", F.coalesce("report_fp", F.sha2(canon_record(*key), 256)))
    else:       # a bare status/severity table: no fingerprint to report
        out = out.withColumn("report_fp", F.lit(None).cast("string"))
    named = "scanner" in executions.columns
    runs = executions.groupBy(*key).agg(
        F.bool_and("network_isolated").alias("_iso"), F.count(F.lit(1)).alias("_runs"),
        (F.array_join(F.array_sort(F.collect_set("scanner")), ",") if named else F.lit("")).alias("scanners"))
    labels = F.array_join("labels", ",") if "labels" in assessments.columns else F.lit(None).cast("string")
    judged = assessments.select(*key, "risk", "confidence", F.size("citations").cast("bigint").alias("citation_count"),
                                labels.alias("labels"))
    out = out.join(judged, key, "left").join(runs, key, "left")
    for extra, name, kind in ((audit, "valid", "boolean"), (durations, "duration_ms", "double")):
        out = (out.withColumn(name, F.lit(None).cast(kind)) if extra is None
               else out.join(extra.select(*key, F.col(name).cast(kind).alias(name)), key, "left"))
    tallies = F.coalesce("_p", F.array().cast("array<struct<status:string,severity:string,n:bigint>>"))
    out = out.withColumn("_p", tallies)

    def total(keep=lambda p: F.lit(True)) -> Column:
        return F.aggregate(F.filter("_p", keep), F.lit(0).cast("bigint"), lambda n, p: n + p["n"])
    return out.select(
        *key, F.col("report_fp").alias("report_fingerprint"), total().alias("observations"),
        total(lambda p: p["status"] == "review").alias("to_review"), total(lambda p: p["status"] == "pass").alias("passed"),
        _tally("_p", "status").alias("status_counts"), _tally("_p", "severity").alias("severity_counts"),
        "risk", "confidence", "citation_count", "labels",
        F.coalesce("_runs", F.lit(0)).cast("bigint").alias("executions"), F.coalesce("scanners", F.lit("")).alias("scanners"),
        F.coalesce("_iso", F.lit(True)).alias("all_isolated"), F.col("valid").alias("audit_verified"),
        F.col("duration_ms").alias("provider_duration_ms"),
        *(F.lit(False).alias(c) for c in NOT_CLAIMED))


# what the metrics never claim
NOT_CLAIMED = ("claims_full_coverage", "claims_certification", "claims_production_testing")


# ---------------------------------------------------------------- J2
def management_summary(metrics: DataFrame) -> DataFrame:
    """The J1 figures of a report as a Markdown table with a line on their limits."""
    def yes(c: str, unknown: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit(unknown)).when(F.col(c), F.lit("yes")).otherwise(F.lit("no"))

    def text(c: str, none: str) -> Column:
        return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(none))
    seconds = F.when(F.col("provider_duration_ms").isNull(), F.lit("-")).otherwise(
        F.format_string("%.1f", F.round(F.col("provider_duration_ms") / 1000.0, 1)))
    rows = (("risk", text("risk", "-")), ("findings", F.col("observations").cast("string")),
            ("open for review", F.col("to_review").cast("string")), ("controls seen", F.col("passed").cast("string")),
            ("by severity", text("severity_counts", "-")), ("scanners", text("scanners", "-")),
            ("scanners offline", yes("all_isolated", "?")), ("quotes traced", text("citation_count", "0")),
            ("triage, s", seconds), ("audit chain intact", yes("audit_verified", "?")))
    lines = [F.concat(F.lit("## "), F.col("repository_id"), F.lit(" ("), F.col("engagement_id"), F.lit(")")),
             F.lit(""), F.lit("| figure | value |"), F.lit("|---|---|")]
    lines += [F.concat(F.lit(f"| {name} | "), value, F.lit(" |")) for name, value in rows]
    lines += [F.lit(""), F.lit("Figures come from automatic rules: other flaws may exist, and no norm is attested.")]
    return metrics.select("engagement_id", "repository_id", F.concat_ws("\n", *lines).alias("summary_md"))


# ---------------------------------------------------------------- J3
PAGE = 100      # observations on an evidence page


def neutralize_fences(c: Column) -> Column:
    return F.replace(c, F.lit(FENCE), F.lit(FENCE_NEUTRAL))


def evidence_pack(cases: DataFrame, observations: DataFrame, assessments: DataFrame, state: DataFrame | None = None,
                  audit_verified: DataFrame | None = None, page: int = PAGE,
                  key: Sequence[str] = ("engagement_id", "repository_id")) -> DataFrame:
    """The evidence pack of every case as rows ``(case_id, page, first_pos,
    n_items, page_md)``.  Page 0 is the cover (state, audit check, risk, quotes);
    the pages after it hold *all* observations of the report, ``page`` positions
    each, as JSON with code fences neutralized.  A task gathers one page at most,
    so a report of any size is spread out."""
    key = list(key)
    quotes = F.coalesce("citations", F.array().cast("array<struct<source_id:string,quote:string>>"))
    judged = assessments.select("case_id", "risk", "confidence", "summary", F.array_join(F.transform(
        quotes, lambda c: F.concat(F.lit("* ["), c["source_id"], F.lit("] "), c["quote"])), "\n").alias("_quotes"))
    j = cases.join(judged, "case_id", "left")
    stage, checked = F.lit("pending_approval"), F.lit("unchecked")
    if state is not None:
        j = j.join(state.select("case_id", F.col("state").alias("_state")), "case_id", "left")
        stage = F.coalesce(F.col("_state"), F.lit("received"))
    if audit_verified is not None:
        j = j.join(audit_verified.select("case_id", F.col("valid").alias("_valid")), "case_id", "left")
        checked = F.when(F.col("_valid").isNull(), checked).when(F.col("_valid"), F.lit("intact")).otherwise(F.lit("broken"))
    facts = (("case", F.col("case_id")), ("state", stage), ("audit", checked), ("risk", F.coalesce("risk", F.lit("-"))),
             ("confidence", F.coalesce(F.format_string("%.2f", F.round("confidence", 2)), F.lit("-"))))
    cover = F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.lit(""),
                        *(F.concat(F.lit(f"{name}: "), value) for name, value in facts), F.lit(""),
                        F.coalesce("summary", F.lit("Not assessed.")), F.lit(""), F.lit("Quotes"), F.coalesce("_quotes", F.lit("")))
    covers = j.select("case_id", F.lit(0).cast("bigint").alias("page"), F.lit(None).cast("bigint").alias("first_pos"),
                      F.lit(0).cast("bigint").alias("n_items"), neutralize_fences(cover).alias("page_md"))
    fields = [c for c in ("observation_id", "check", "status", "severity", "path", "message") if c in observations.columns]
    dealt = observations.withColumn("_page", F.floor(F.col("pos") / F.lit(page)).cast("bigint"))
    pages = (dealt.groupBy(*key, "_page").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("_items"))
             .join(cases.select(*key, "case_id"), key))
    body = F.to_json(F.transform("_items", lambda o: F.struct(*(o[f].alias(f) for f in fields))))
    return covers.unionByName(pages.select(
        "case_id", (F.col("_page") + 1).alias("page"), F.col("_items")[0]["pos"].alias("first_pos"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.concat(F.lit(FENCE + "json\n"), neutralize_fences(body), F.lit("\n" + FENCE)).alias("page_md")))


# ---------------------------------------------------------------- J4 / J5
def counters(audit: DataFrame, event: str = "event") -> DataFrame:
    """Events by name."""
    return audit.groupBy(F.col(event).alias("name")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def observed_counters(audit: DataFrame, events: Sequence[str], event: str = "event") -> tuple[DataFrame, Observation]:
    """J4 in flight: the same rows, and an observation that holds the count of each of ``events`` once an
    action has run over all of them (``observation.get``); no scan of its own.  A null or unlisted event counts under ``(other)``."""
    seen = Observation()
    n = [F.count(F.when(F.col(event) == e, True)).alias(e) for e in events]
    other = F.count(F.when(~F.coalesce(F.col(event).isin(*events), F.lit(False)), True)).alias("(other)")
    return audit.observe(seen, *n, other), seen


def latency(durations: DataFrame, name: str = "name", value: str = "duration_ms", ts: str = "ts",
            quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Per measurement name: count, last value, and exact nearest-rank
    percentiles (value at rank ceil(q·n)), from one global rank over
    (name, value, ts) — a large name is split over many tasks."""
    r = global_rank(durations.select(name, value, ts), [F.col(name), F.col(value), F.col(ts)], "_rk").df
    r = rank_within(r, [name], "_rk", "_rn", "_n")
    aggs = [F.max("_n").cast("bigint").alias("count"), F.max_by(value, ts).alias("last")]
    for q in quantiles:
        aggs.append(F.max(F.when(F.col("_rn") == F.ceil(F.lit(float(q)) * F.col("_n")), F.col(value)))
                    .alias(f"p{int(round(q * 100))}"))
    return r.groupBy(name).agg(*aggs)


SKETCH_K = 400
RANK_ERROR = 0.01       # of a quantile from the sketches, at SKETCH_K


def latency_sketches(durations: DataFrame, name: str = "name", value: str = "duration_ms", ts: str = "ts", k: int = SKETCH_K) -> DataFrame:
    """J5 in mergeable form: per (name, day) the count and a KLL sketch of the values.  A day's row is
    final once the day is over, and any span of days is their merge; nothing is ranked or sorted."""
    return durations.groupBy(F.col(name).alias("name"), F.to_date(ts).alias("day")).agg(
        F.count(value).cast("bigint").alias("count"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def latency_levels(sketches: DataFrame, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Quantiles per (name, day) and, with a null day, per name from the merged days; right within ``RANK_ERROR`` of the rank."""
    total = sketches.groupBy("name").agg(F.sum("count").alias("count"), F.kll_merge_agg_double("sketch").alias("sketch"))
    both = sketches.unionByName(total.withColumn("day", F.lit(None).cast("date")))
    return both.select("name", "day", "count", *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"p{int(round(q * 100))}") for q in quantiles])


# ---------------------------------------------------------------- J6
def workflow_sli(audit: DataFrame, case: str = "case_id", event: str = "event", ts: str = "ts") -> DataFrame:
    """Completion, failure, retry, input rejection, publish dedupe rates
    and the mean approval wait (seconds from the first completion to the
    first approval of a case).  One per-case partial aggregate, then one
    global aggregate over the cases — no join."""
    def n(e):
        return F.sum((F.col(event) == e).cast("long")).alias(e)
    names = (EV_RECEIVED, EV_COMPLETED, EV_FAILED, EV_RETRY, EV_INPUT_REJECTED, EV_PUBLISHED, EV_PUBLISH_DEDUP)
    per_case = audit.groupBy(case).agg(
        *[n(e) for e in names],
        F.min(F.when(F.col(event) == EV_COMPLETED, F.col(ts))).alias("_c"),
        F.min(F.when(F.col(event) == EV_APPROVED, F.col(ts))).alias("_a"))
    waited = F.col("_a") >= F.col("_c")
    wait_us = F.unix_micros(F.col("_a").cast("timestamp")) - F.unix_micros(F.col("_c").cast("timestamp"))
    tot = per_case.agg(*[F.sum(e).alias(e) for e in names], F.avg(F.when(waited, wait_us)).alias("_w"))

    def rate(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return tot.select(
        F.col(EV_RECEIVED).alias("received"), rate(EV_COMPLETED, EV_RECEIVED).alias("completion_rate"),
        rate(EV_FAILED, EV_RECEIVED).alias("failure_rate"),
        rate(EV_RETRY, EV_RECEIVED).alias("retry_rate"),
        F.when(F.col(EV_RECEIVED) + F.col(EV_INPUT_REJECTED) > 0,
               F.col(EV_INPUT_REJECTED) / (F.col(EV_RECEIVED) + F.col(EV_INPUT_REJECTED))).alias("rejection_rate"),
        F.when(F.col(EV_PUBLISHED) + F.col(EV_PUBLISH_DEDUP) > 0,
               F.col(EV_PUBLISH_DEDUP) / (F.col(EV_PUBLISHED) + F.col(EV_PUBLISH_DEDUP))).alias("publish_dedupe_rate"),
        (F.col("_w") / 1e6).alias("mean_approval_wait_s"))


# ---------------------------------------------------------------- J7
def markdown_table(df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
                   formats: dict[str, str] | None = None) -> DataFrame:
    """A small result table (per-class metrics, a confusion matrix) as a
    Markdown text: header, separator and one line per row in ``order_by``
    order.  Meant for aggregated tables whose row count is bounded by the
    label list."""
    formats = formats or {}
    cells = [F.format_string(formats[c], F.col(c)) if c in formats else F.coalesce(F.col(c).cast("string"), F.lit(""))
             for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = df.select(F.struct(*[F.col(c) for c in order_by]).alias("_o"), line.alias("_l"))
    body = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))),
                                             lambda e: e["_l"]), "\n").alias("_b"))
    header = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return body.select(F.concat(F.lit(header), F.coalesce("_b", F.lit(""))).alias("table_md"))
