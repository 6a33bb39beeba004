"""The approval workflow as set-at-a-time operators.

State table: ``(case_id, case_fingerprint, state, risk, assessment_fp,
reviewer, receipt, updated_seq)``.  Every operator takes the state snapshot and
a batch of inputs and returns outcomes; nothing is decided by a driver loop.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canon_record, case_fingerprints, idempotency_key
from ..functions.scan import fsm_fold
from ..functions.text import is_blank
from . import triage, validate

# Workflow states (declaration order).
STATES = ("received", "pending_approval", "approved", "published", "rejected", "failed")
STATE_IDS = {s: i + 1 for i, s in enumerate(STATES)}  # 0 = no state yet

# Allowed transitions (from → to) of the replayed state machine:
# a new or retried analysis is received; analysis ends pending or failed;
# approval needs a pending case; publication needs an approved case.
TRANSITIONS = (
    (None, "received"), ("failed", "received"),
    ("received", "pending_approval"), ("received", "failed"),
    ("pending_approval", "approved"),
    ("approved", "published"),
)
# Accepted transitions that leave the state as it is — a
# published case absorbs further approvals (silent no-op) and publications
# (deduplicated).
NOOP_TRANSITIONS = (("published", "approved"), ("published", "published"))
REJECT_TRANSITION = ("pending_approval", "rejected")

# Reasons, which results must equal.
MSG_UNKNOWN_CASE = "unknown case_id: "
MSG_NOT_PENDING = "cannot approve a case in state "
MSG_REVIEWER = "a named reviewer is required"

MAX_ATTEMPTS = 3
BASE_DELAY_SECONDS = 0.01


def transition_matrix(allow_reject: bool = False) -> list[list[int]]:
    """Next-state matrix ``m[from][to]`` over state ids (0 = none yet);
    -1 marks a rejected transition."""
    n = len(STATES) + 1
    m = [[-1] * n for _ in range(n)]
    pairs = list(TRANSITIONS) + ([REJECT_TRANSITION] if allow_reject else [])
    for a, b in pairs:
        m[0 if a is None else STATE_IDS[a]][STATE_IDS[b]] = STATE_IDS[b]
    for a, b in NOOP_TRANSITIONS:
        m[STATE_IDS[a]][STATE_IDS[b]] = STATE_IDS[a]
    return m


def state_name(c: Column) -> Column:
    # get() is 0-based and null outside the array (element_at with a null
    # index over a literal array returned the last element here)
    return F.get(F.array(*[F.lit(s) for s in STATES]), c - 1)


def state_id(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATES]), c).cast("int"), F.lit(0))


# ---------------------------------------------------------------- G1
def admit(submissions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """G1: per submission (case_id, seq, fingerprint[, outcome]) → admission
    new / deduplicated / retried / conflict, as if analyzed one by one in seq order.

    ``outcome`` is what the analysis of that submission gives if it is admitted: ``success``,
    ``failed`` (the case is stored as failed) or ``rejected`` (by the input rules: nothing is
    stored, or a failed case stays failed).  Without the column every analysis succeeds.

    A case stores the fingerprint of its first submission that is not rejected, unless the
    state has one.  A differing fingerprint is a conflict.  Matching submissions are retries as
    long as the case is failed, that is up to the first that succeeds, and deduplicated after it.
    Two aggregates by case hold all of that, so a case with any number of submissions is split over tasks.
    """
    s = submissions if "outcome" in submissions.columns else submissions.withColumn("outcome", F.lit("success"))
    kept = F.when(F.col("outcome") != "rejected", F.col("seq"))
    first = s.groupBy("case_id").agg(F.min(kept).alias("_stored_at"), F.min_by("fingerprint", kept).alias("_first_fp"))
    if state is not None:
        st = state.select("case_id", F.col("case_fingerprint").alias("_st_fp"), F.col("state").alias("_st_state"))
        first = first.join(st, "case_id", "left")
    else:
        first = first.withColumn("_st_fp", F.lit(None).cast("string")).withColumn("_st_state", F.lit(None).cast("string"))
    known = F.col("_st_state").isNotNull()
    first = first.withColumn("_stored", F.coalesce("_st_fp", "_first_fp"))
    s = s.join(first, "case_id")
    # before the first stored submission of an unknown case nothing matches or conflicts
    new = ~known & (F.col("_stored_at").isNull() | (F.col("seq") <= F.col("_stored_at")))
    match = ~new & (F.col("fingerprint") == F.col("_stored")) | (~known & (F.col("seq") == F.col("_stored_at")))
    settled = s.where(match & (F.col("outcome") == "success")).groupBy("case_id").agg(F.min("seq").alias("_settled"))
    s = s.join(settled, "case_id", "left")
    admission = (
        F.when(new, F.lit("new"))
        .when(F.col("fingerprint") != F.col("_stored"), F.lit("conflict"))
        .when(known & (F.col("_st_state") != "failed"), F.lit("deduplicated"))
        .when(F.col("seq") > F.col("_settled"), F.lit("deduplicated"))
        .otherwise(F.lit("retried"))
    )
    return s.select("case_id", "seq", "fingerprint", admission.alias("admission"))


# ---------------------------------------------------------------- G2 / G3
def retry_outcome(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """attempts(case_id, attempt 1-based, outcome success/transient/
    permanent) → per case final state, provider retries, failure events.

    The first non-transient attempt within ``max_attempts`` decides;
    ``max_attempts`` transient attempts fail the case.  Fewer logged attempts
    than that leave it ``retrying``.
    """
    a = attempts.where(F.col("attempt") <= F.lit(max_attempts))
    decisive = F.col("outcome") != "transient"
    agg = a.groupBy("case_id").agg(
        F.min(F.when(decisive, F.col("attempt"))).alias("_dec"),
        F.min_by(F.when(decisive, F.col("outcome")), F.when(decisive, F.col("attempt"))).alias("_dec_outcome"),
        F.sum((~decisive).cast("int")).alias("_n_transient"),
    )
    final = (
        F.when(F.col("_dec_outcome") == "success", F.lit("pending_approval"))
        .when(F.col("_dec_outcome").isNotNull(), F.lit("failed"))
        .when(F.col("_n_transient") >= F.lit(max_attempts), F.lit("failed"))
        .otherwise(F.lit("retrying"))
    )
    retries = F.when(F.col("_dec").isNotNull(), F.col("_dec") - 1).otherwise(F.col("_n_transient"))
    return agg.select(
        "case_id", final.alias("final_state"),
        retries.cast("bigint").alias("provider_retries"),
        F.when(final == "failed", F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("failure_events"),
        F.coalesce(F.col("_dec"), F.col("_n_transient")).cast("bigint").alias("attempts_used"),
    )


def provider_retries(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Attempts(case_id, attempt, outcome[, reason]) → per case ``provider_state`` (as G2's final state), the
    audited ``retries array<struct<attempt, reason>>`` (``max_attempts`` at most) and ``provider_reason``, that of a permanent failure."""
    if "reason" not in attempts.columns:
        attempts = attempts.withColumn("reason", F.lit(None).cast("string"))
    a = attempts.where(F.col("attempt") <= F.lit(max_attempts))
    rows = a.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("attempt").cast("bigint").alias("attempt"), "reason", "outcome"))).alias("_a"))       # max_attempts entries
    decisive = F.get(F.filter("_a", lambda x: x["outcome"] != "transient"), 0)
    before = F.filter("_a", lambda x: (x["outcome"] == "transient") & (decisive.isNull() | (x["attempt"] < decisive["attempt"])))
    rows = rows.select("case_id", F.transform(before, lambda x: F.struct(x["attempt"].alias("attempt"), x["reason"].alias("reason"))).alias("retries"),
                       F.when(decisive["outcome"] == "permanent", decisive["reason"]).alias("provider_reason"))
    return retry_outcome(attempts, max_attempts).select("case_id", F.col("final_state").alias("provider_state")).join(rows, "case_id")


def backoff_schedule(attempts: DataFrame, base_delay: float = BASE_DELAY_SECONDS,
                     max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Delay after each transient attempt = base·2^(attempt-1); none
    after the last allowed attempt.  Cumulative wait by attempt order."""
    from pyspark.sql import Window
    a = attempts.where((F.col("attempt") <= F.lit(max_attempts)))
    # attempts after the decisive one never happen
    dec = a.groupBy("case_id").agg(F.min(F.when(F.col("outcome") != "transient", F.col("attempt"))).alias("_dec"))
    a = a.join(dec, "case_id").where(F.col("_dec").isNull() | (F.col("attempt") <= F.col("_dec")))
    delay = F.when((F.col("outcome") == "transient") & (F.col("attempt") < F.lit(max_attempts)),
                   F.lit(float(base_delay)) * F.pow(F.lit(2.0), (F.col("attempt") - 1).cast("double")))
    a = a.withColumn("delay_s", delay)
    # ≤ max_attempts rows per case reach this window
    w = Window.partitionBy("case_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    return a.select("case_id", F.col("attempt").cast("bigint").alias("attempt"), "outcome", "delay_s",
                    F.coalesce(F.sum("delay_s").over(w), F.lit(0.0)).alias("cumulative_wait_s"))


# ---------------------------------------------------------------- G4
def fold_states(events: DataFrame, allow_reject: bool = False,
                num_partitions: int | None = None) -> DataFrame:
    """events(case_id, seq, to_state) replayed in seq order.  Returns per
    event from_state, state (after) and accepted; illegal transitions are
    rejected and leave the state unchanged.  Hot cases are split across tasks
    (see ``functions.scan``)."""
    ev = events.select("case_id", "seq", state_id(F.col("to_state")).alias("_to"))
    folded = fsm_fold(ev, "case_id", "seq", "_to", transition_matrix(allow_reject), num_partitions)
    return folded.select(
        "case_id", "seq", state_name(F.col("_to")).alias("to_state"),
        state_name(F.col("state_before")).alias("from_state"),
        state_name(F.col("state_after")).alias("state"),
        "accepted",
    )


def final_states(folded: DataFrame) -> DataFrame:
    """Per case: final state, accepted and rejected transition counts."""
    return folded.groupBy("case_id").agg(
        F.max_by("state", "seq").alias("state"),
        F.sum(F.col("accepted").cast("int")).cast("bigint").alias("accepted"),
        F.sum((~F.col("accepted")).cast("int")).cast("bigint").alias("rejected"),
    )


# ---------------------------------------------------------------- G5
def approve(state: DataFrame, decisions: DataFrame, allow_reject: bool = False) -> DataFrame:
    """decisions(case_id, seq, reviewer[, decision]) → per decision
    outcome.

    Unknown case → error; published → silent no-op; otherwise only a pending
    case with a non-blank reviewer is decided — by the first such decision in
    seq order; blank reviewers before it are errors, decisions after it see
    the decided case (error, as approving twice is).  ``decision = 'reject'``
    moves a pending case to ``rejected`` when ``allow_reject`` is on (an
    extension: the reference declares the state but never reaches it);
    otherwise a reject decision is an error.
    """
    if "decision" not in decisions.columns:
        decisions = decisions.withColumn("decision", F.lit("approve"))
    is_reject = F.coalesce(F.col("decision") == "reject", F.lit(False))
    st = state.select("case_id", F.col("state").alias("_state"))
    d = decisions.join(st, "case_id", "left")
    valid_kind = ~is_reject | F.lit(allow_reject)
    first_ok = d.where((F.col("_state") == "pending_approval") & ~is_blank("reviewer") & valid_kind).groupBy(
        "case_id").agg(F.min_by(F.struct("seq", "decision"), "seq").alias("_ok"))
    d = d.join(first_ok, "case_id", "left")
    ok_seq = F.col("_ok.seq")
    decided = F.when(F.coalesce(F.col("_ok.decision") == "reject", F.lit(False)), F.lit("rejected")) \
        .otherwise(F.lit("approved"))
    eff_state = F.when(ok_seq.isNotNull() & (F.col("seq") > ok_seq), decided).otherwise(F.col("_state"))
    outcome = (
        F.when(F.col("_state").isNull(), F.lit("error"))
        .when(eff_state == "published", F.lit("noop"))
        .when(eff_state != "pending_approval", F.lit("error"))
        .when(is_blank("reviewer"), F.lit("error"))
        .when(is_reject & F.lit(not allow_reject), F.lit("error"))
        .when(is_reject, F.lit("rejected"))
        .otherwise(F.lit("approved"))
    )
    message = (
        F.when(F.col("_state").isNull(), F.concat(F.lit(MSG_UNKNOWN_CASE), F.col("case_id")))
        .when(eff_state == "published", F.lit(None))
        .when(eff_state != "pending_approval", F.concat(F.lit(MSG_NOT_PENDING), eff_state))
        .when(is_blank("reviewer"), F.lit(MSG_REVIEWER))
        .when(is_reject & F.lit(not allow_reject), F.lit("rejection is not enabled"))
    )
    return d.select("case_id", "seq", "reviewer", outcome.alias("outcome"), message.alias("message"))


def apply_approvals(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """New state table after G5: approved or rejected cases take the new
    state and reviewer."""
    ok = outcomes.where(F.col("outcome").isin("approved", "rejected")).select(
        "case_id", F.col("reviewer").alias("_rev"), F.col("outcome").alias("_new"))
    return state.join(ok, "case_id", "left").select(
        *[F.coalesce(F.col("_new"), F.col("state")).alias("state")
          if c == "state" else
          (F.coalesce(F.col("_rev"), F.col("reviewer")).alias("reviewer") if c == "reviewer" else F.col(c))
          for c in state.columns])


# ---------------------------------------------------------------- G6
def publish(state: DataFrame, requests: DataFrame, exported: DataFrame | None = None,
            destination: str = "handoff") -> DataFrame:
    """requests(case_id, seq) → per request outcome published /
    deduplicated / blocked / error, with the receipt.

    Only an approved case publishes, once: the first request in seq order;
    later requests and requests for published cases return the stored
    receipt.  The export side effect happens once per idempotency key: keys
    already in ``exported(idempotency_key)`` are not exported again.
    """
    st = state.select("case_id", F.col("state").alias("_state"), F.col("receipt").alias("_receipt"),
                      idempotency_key("case_fingerprint", "assessment_fp").alias("_key"))
    r = requests.join(st, "case_id", "left")
    first = r.where(F.col("_state") == "approved").groupBy("case_id").agg(F.min("seq").alias("_first"))
    r = r.join(first, "case_id", "left")
    slug = F.substring(F.sha2(F.col("case_id"), 256), 1, 20)
    new_receipt = F.concat(F.lit(f"file:{destination}/approved-"), slug, F.lit(".json"))
    outcome = (
        F.when(F.col("_state").isNull(), F.lit("error"))
        .when(F.col("_state") == "published", F.lit("deduplicated"))
        .when(F.col("_first").isNotNull() & (F.col("seq") == F.col("_first")), F.lit("published"))
        .when(F.col("_first").isNotNull(), F.lit("deduplicated"))
        .otherwise(F.lit("blocked"))
    )
    receipt = (F.when(outcome == "published", new_receipt)
               .when(F.col("_state") == "published", F.col("_receipt"))
               .when(outcome == "deduplicated", new_receipt))
    out = r.select("case_id", "seq", outcome.alias("outcome"), receipt.alias("receipt"),
                   F.col("_key").alias("idempotency_key"))
    if exported is not None:
        done = exported.select("idempotency_key").distinct().withColumn("_done", F.lit(True))
        out = out.join(done, "idempotency_key", "left").withColumn(
            "export", (F.col("outcome") == "published") & F.col("_done").isNull()).drop("_done")
    else:
        out = out.withColumn("export", F.col("outcome") == "published")
    return out


# ---------------------------------------------------------------- G7
MSG_NO_ANSWER = "the classifier gave no answer"
MSG_PROVIDER = "the provider failed"


def analyze(headers: DataFrame, sources: DataFrame, *,
            classifier: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
            validators: Sequence[Callable[[DataFrame], Column]] = (),
            state: DataFrame | None = None, attempts: DataFrame | None = None,
            max_attempts: int = MAX_ATTEMPTS,
            max_chars: int = validate.MAX_SOURCE_CHARS) -> DataFrame:
    """Admission → input rules (E1) → classifier → assessment rules
    (E4/E5) → extra validators (E6 …) → pending_approval or failed, one plan.
    A case without an answer, or with one that did not parse or has no known
    risk, fails.

    Output per case: case_id, admission, input_reason, risk, summary, labels,
    citations, confidence, reason, state.  An input rejection stores nothing
    (state null); a deduplicated case keeps its stored state.

    ``attempts(case_id, attempt, outcome[, reason])`` is the provider's log (see G2): an admitted, valid case whose
    attempts end in a permanent failure, or in ``max_attempts`` transient ones, fails without an answer; one
    with fewer transient attempts stays ``received``; a case without attempts counts as answered at once.
    The output then has ``retries array<struct<attempt, reason>>`` as well.
    """
    classifier = classifier or triage.keyword_classify
    cases = headers
    if state is not None:
        fps = case_fingerprints(headers, sources)
        st = state.select("case_id", F.col("case_fingerprint").alias("_st_fp"),
                          F.col("state").alias("_st_state"))
        cases = headers.join(fps, "case_id", "left").join(st, "case_id", "left").withColumn(
            "admission",
            F.when(F.col("_st_fp").isNull(), F.lit("new"))
            .when(F.col("_st_fp") != F.col("fingerprint"), F.lit("conflict"))
            .when(F.col("_st_state") != "failed", F.lit("deduplicated"))
            .otherwise(F.lit("retried")))
    else:
        cases = headers.withColumn("admission", F.lit("new")).withColumn(
            "_st_state", F.lit(None).cast("string"))
    proceed = cases.where(F.col("admission").isin("new", "retried")).select("case_id", "title")
    # one aggregate for the input rules; the classifier and the grounding
    # join run over all cases and their results are masked for rejected
    # inputs below, so no stage reads the rule results back through
    # semi-joins (each of which would recompute them)
    input_check = validate.validate_cases(proceed, sources, max_chars)
    assessed = classifier(proceed, sources)
    checks = validate.validate_assessments(assessed, sources).withColumnRenamed("reason", "_r1")
    a = assessed.join(checks, "case_id", "left")
    extra = [v(a) for v in validators]
    # an answer that did not parse, or names no known risk, is a failure whatever else it says
    unread = ~F.coalesce(F.col("risk").isin(*validate.RISKS), F.lit(False))
    if "parse_ok" in a.columns:
        unread = unread | ~F.coalesce(F.col("parse_ok"), F.lit(False))
    reason = F.coalesce(F.when(unread, F.lit(validate.MSG_INVALID_OUTPUT)), F.col("_r1"), *extra)
    a = a.withColumn("_reason", reason).withColumn("_answered", F.lit(True)).drop("_r1")
    out = (cases.select("case_id", "admission", "_st_state")
           .join(input_check.withColumnRenamed("reason", "input_reason"), "case_id", "left")
           .join(a, "case_id", "left"))
    ran = F.col("admission").isin("new", "retried") & F.col("input_reason").isNull()
    provider, waits = F.lit(None).cast("string"), F.lit(False)
    extra_cols = []
    if attempts is not None:
        out = out.join(provider_retries(attempts, max_attempts), "case_id", "left")
        waits = F.coalesce(F.col("provider_state") == "retrying", F.lit(False))
        provider = F.when(F.col("provider_state") == "failed", F.coalesce("provider_reason", F.lit(MSG_PROVIDER)))
        extra_cols = [F.when(ran, F.col("retries")).alias("retries")]
    heard = ran & ~waits & provider.isNull()
    masked = [F.when(heard, F.col(c)).alias(c) for c in a.columns if c not in ("case_id", "_reason", "_answered")]
    silent = F.when(F.col("_answered").isNull(), F.lit(MSG_NO_ANSWER))      # the classifier returned no row
    out = out.select("case_id", "admission", "_st_state", "input_reason", *masked, (ran & waits).alias("_waits"),
                     F.when(ran & ~waits, F.coalesce(provider, silent, F.col("_reason"))).alias("reason"), *extra_cols)
    state_col = (
        F.when(F.col("admission").isin("deduplicated", "conflict"), F.col("_st_state"))
        .when(F.col("input_reason").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("_waits"), F.lit("received"))
        .when(F.col("reason").isNotNull(), F.lit("failed"))
        .otherwise(F.lit("pending_approval"))
    )
    return out.withColumn("state", state_col).drop("_st_state", "_waits")


def analysis_events(result: DataFrame) -> DataFrame:
    """Audit rows of G7 in emission order: (case_id, step, event, attempt, reason, risk).  ``attempt`` and its reason belong
    to ``provider_retry``, a reason to ``input_rejected`` and ``analysis_failed``, the risk to ``analysis_completed``."""
    kind = "array<struct<event:string,attempt:bigint,reason:string,risk:string>>"
    null = F.lit(None)

    def row(event, attempt=null, reason=null, risk=null):
        return F.struct(F.lit(event).alias("event"), attempt.cast("bigint").alias("attempt"),
                        reason.cast("string").alias("reason"), risk.cast("string").alias("risk"))

    def some(*rows):
        return F.array(*rows).cast(kind)

    retries = (F.transform("retries", lambda x: row("provider_retry", x["attempt"], x["reason"])).cast(kind)
               if "retries" in result.columns else F.array().cast(kind))
    end = (F.when(F.col("reason").isNotNull(), some(row("analysis_failed", reason=F.col("reason"))))
           .when(F.col("state") == "received", F.array().cast(kind))
           .otherwise(some(row("analysis_completed", risk=F.col("risk")))))
    ran = F.concat(some(row("case_received")), F.coalesce(retries, F.array().cast(kind)), end)
    rows = (F.when(F.col("admission") == "deduplicated", some(row("analysis_deduplicated")))
            .when(F.col("admission") == "conflict", F.array().cast(kind))
            .otherwise(F.concat(
                F.when(F.col("admission") == "retried", some(row("analysis_retried"))).otherwise(F.array().cast(kind)),
                F.when(F.col("input_reason").isNotNull(), some(row("input_rejected", reason=F.col("input_reason")))).otherwise(ran))))
    return result.select("case_id", F.posexplode(rows).alias("step", "e")).select("case_id", "step", "e.*")


def approval_events(outcomes: DataFrame) -> DataFrame:
    """Audit rows of G5: (case_id, seq, event, reviewer) of the decisions that took effect."""
    return outcomes.where(F.col("outcome") == "approved").select(
        "case_id", "seq", F.lit("case_approved").alias("event"), "reviewer")


def publication_events(outcomes: DataFrame) -> DataFrame:
    """Audit rows of G6: (case_id, seq, event, receipt); an unknown case leaves none."""
    event = (F.when(F.col("outcome") == "published", F.lit("case_published"))
             .when(F.col("outcome") == "deduplicated", F.lit("publish_deduplicated"))
             .when(F.col("outcome") == "blocked", F.lit("publish_blocked")))
    return outcomes.select("case_id", "seq", event.alias("event"), "receipt").where(F.col("event").isNotNull())


# ---------------------------------------------------------------- G8 / G9
def case_summaries(state: DataFrame) -> DataFrame:
    """Listing, newest first (updated_seq desc, case_id)."""
    return state.select("case_id", "state", "risk", "reviewer", "updated_seq").orderBy(
        F.col("updated_seq").desc(), F.col("case_id"))


def lookup(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """Point reads; an unknown id yields an error row."""
    j = wanted.select("case_id").join(state, "case_id", "left")
    return j.withColumn("error", F.when(F.col("state").isNull(),
                                        F.concat(F.lit(MSG_UNKNOWN_CASE), F.col("case_id"))))


def assessment_fingerprint(df: DataFrame) -> Column:
    """B1 of an assessment: risk, summary, confidence, labels and citations in
    order (arrays of a single assessment are small)."""
    labels = F.array_join(F.transform(F.coalesce("labels", F.array().cast("array<string>")),
                                      lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "")
    cites = F.array_join(F.transform(F.coalesce("citations", F.array().cast(
        "array<struct<source_id:string,quote:string>>")), lambda c: canon_record(c["source_id"], c["quote"])), "")
    return F.sha2(F.concat(canon_record("risk", "summary", F.format_string("%.6f", F.col("confidence"))),
                           canon_record(labels), canon_record(cites)), 256)
