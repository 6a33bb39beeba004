"""Fixture views: the evidence-review data model laid over the driver's
tables (documented in FIXTURES.md §3).  Every view is a lazy DataFrame derived
from the whole table; no sampling, no id subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table  # noqa: F401  (re-exported)

# Keyword tiers for conversation cases (words that occur in the
# synthetic conversation texts; the default tiers never occur there).
CONVERSATION_TIERS = (
    ("critical", ("erth",)),
    ("high", ("tion", "ing")),
    ("medium", ("que", "die")),
)


# ------------------------------------------------------------ cases
def conversation_cases(spark: SparkSession, sf_dir: str, source_id: str = "turn"):
    """headers(case_id, title), sources(case_id, pos, source_id, text):
    one case per conversation, one source per turn.  ``source_id='role'``
    gives the variant whose repeated roles break the uniqueness rule."""
    conv = table(spark, sf_dir, "conversations")
    headers = conv.select("conv_id").distinct().select(
        F.col("conv_id").cast("string").alias("case_id"),
        F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"),
    )
    sid = F.col("turn").cast("string") if source_id == "turn" else F.col("role")
    sources = conv.select(
        F.col("conv_id").cast("string").alias("case_id"),
        F.col("turn").cast("bigint").alias("pos"),
        sid.alias("source_id"),
        F.col("text"),
    )
    return headers, sources


def document_cases(spark: SparkSession, sf_dir: str):
    """Single-source cases from documents with an expected risk from labels:
    toxic → critical, low quality → high, otherwise low."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    headers = docs.select(
        F.col("doc_id").cast("string").alias("case_id"),
        F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"),
    )
    sources = docs.select(
        F.col("doc_id").cast("string").alias("case_id"), F.lit(0).cast("bigint").alias("pos"),
        F.col("source").alias("source_id"), F.col("text"))
    golden = labels.select(
        F.col("doc_id").cast("string").alias("case_id"),
        F.when(F.col("toxic") == 1, F.lit("critical"))
        .when(F.col("quality") == 0, F.lit("high")).otherwise(F.lit("low")).alias("expected_risk"),
    )
    return headers, sources, golden


# ------------------------------------------------------------ observations
# Severity of each (return flag, line status) pair; R/O maps to
# a level outside the list, which ranks as medium.
FLAG_SEVERITY = (("A", "F", "critical"), ("A", "O", "high"), ("N", "F", "medium"),
                 ("N", "O", "low"), ("R", "F", "info"), ("R", "O", "unknown"))


def _flag_severity() -> "F.Column":
    expr = F.lit(None).cast("string")
    for flag, status, sev in reversed(FLAG_SEVERITY):
        expr = F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), F.lit(sev)).otherwise(expr)
    return expr


def observations(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    """One observation per line item; report = supplier (repository);
    ``pos`` is the report order (order, line, part), from one global rank, so a
    supplier of any size is split over tasks.  ``materialize`` writes
    the whole table once for plans that read it several
    times (selection, summary, fingerprint, metrics)."""
    from ..functions.rank import global_rank, rank_within
    from ..session import written
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_discount", "l_quantity")
    ranked = global_rank(li, ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"], "_rank", table=True).df
    obs = rank_within(ranked, ["l_suppkey"], "_rank", "_pos", None).select(
        F.lit("eng-1").alias("engagement_id"),
        F.concat(F.lit("repo-"), F.col("l_suppkey").cast("string")).alias("repository_id"),
        (F.col("_pos") - 1).cast("bigint").alias("pos"),
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string")).alias("observation_id"),
        F.concat(F.lit("flag-"), F.col("l_returnflag")).alias("check"),
        F.when(F.col("l_discount") >= 0.05, F.lit("review")).otherwise(F.lit("pass")).alias("status"),
        _flag_severity().alias("severity"),
        F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"),
        F.concat(F.lit("quantity "), F.col("l_quantity").cast("bigint").cast("string"),
                 F.lit(" \"units\"")).alias("message"),
    )
    return written(obs, "observations") if materialize else obs


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier is a report; every nation is an extra repository
    without observations (exercises the empty-report source)."""
    sup = table(spark, sf_dir, "supplier").select(
        F.lit("eng-1").alias("engagement_id"),
        F.concat(F.lit("repo-"), F.col("s_suppkey").cast("string")).alias("repository_id"))
    nat = table(spark, sf_dir, "nation").select(
        F.lit("eng-1").alias("engagement_id"),
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("repository_id"))
    return sup.unionByName(nat)


# ------------------------------------------------------------ SARIF documents
def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SARIF document per order: a run per line status (F before O), a
    result per line item in (line, part, supplier) order.  Some results lack
    a rule id, a level, a message or a location."""
    li = table(spark, sf_dir, "lineitem")
    result = F.struct(
        F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("k"),
        F.struct(
            F.when(F.col("l_tax") > 0, F.concat(F.lit("R"), F.col("l_suppkey").cast("string"))).alias("ruleId"),
            F.when(F.col("l_returnflag") == "A", F.lit("error")).when(F.col("l_returnflag") == "N", F.lit("warning"))
            .when(F.col("l_discount") >= 0.02, F.lit("note")).alias("level"),
            F.when(F.col("l_discount") < 0.09, F.struct(F.concat(
                F.lit("qty "), F.col("l_quantity").cast("bigint").cast("string")).alias("text"))).alias("message"),
            F.when(F.col("l_tax") >= 0.02, F.array(F.struct(F.struct(F.struct(F.concat(
                F.lit("src/"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("uri")).alias(
                "artifactLocation")).alias("physicalLocation")))).otherwise(
                F.array().cast("array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>")).alias("locations"),
        ).alias("r"),
    )
    # one shuffle: all line items of an order, then runs formed per line
    # status inside the (small) per-order array
    items = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(
        F.struct(F.col("l_linestatus").alias("st"), result.alias("x")))).alias("_items"))
    statuses = F.array_sort(F.array_distinct(F.transform("_items", lambda e: e["st"])))
    runs = F.transform(statuses, lambda st: F.struct(
        F.struct(F.struct(F.concat(F.lit("Scan Tool/"), st, F.lit(" #"),
                                   (F.col("l_orderkey") % 3).cast("string")).alias("name")).alias("driver")).alias("tool"),
        F.transform(F.filter("_items", lambda e: e["st"] == st), lambda e: e["x"]["r"]).alias("results")))
    docs = items.select("l_orderkey", runs.alias("runs"))
    return docs.select(
        F.col("l_orderkey").alias("doc_id"), F.lit("eng-1").alias("engagement_id"),
        F.concat(F.lit("repo-"), (F.col("l_orderkey") % 10).cast("string")).alias("repository_id"),
        F.struct(F.lit("2.1.0").alias("version"), F.col("runs")).alias("sarif"))


# ------------------------------------------------------------ files / controls
# Order-priority "controls" for the files fixture.
PRIORITY_CONTROLS = (
    ("urgent", ("1-URGENT", "2-HIGH"), "high"),
    ("medium", ("3-MEDIUM",), "medium"),
    ("routine", ("4-NOT SPECIFIED", "5-LOW"), "low"),
)


def repository_files(spark: SparkSession, sf_dir: str):
    """repositories = customers with orders, files = their order priorities."""
    orders = table(spark, sf_dir, "orders")
    files = orders.select(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("repository_id"),
                          F.col("o_orderpriority").alias("path"))
    repos = files.select("repository_id").distinct().withColumn("engagement_id", F.lit("eng-1"))
    return repos, files


# ------------------------------------------------------------ scopes
def scopes(spark: SparkSession, sf_dir: str):
    """A scope per nation; its repositories are the nation's customers with
    every tenth customer left out.  Version, egress and expiry vary by
    nation; ids keep the '#' of the customer name for balances under -950."""
    nation = table(spark, sf_dir, "nation")
    cust = table(spark, sf_dir, "customer")
    sc = nation.select(
        F.concat(F.lit("nat-"), F.col("n_nationkey").cast("string")).alias("engagement_id"),
        F.when(F.col("n_nationkey") == 7, F.lit(2)).otherwise(F.lit(1)).alias("version"),
        F.element_at(F.array(*[F.lit(x) for x in ("deny", "local-only", "allow", "open")]),
                     (F.col("n_nationkey") % 4 + 1).cast("int")).alias("egress"),
        F.col("n_name").alias("customer"),
        F.date_add(F.to_date(F.lit("2030-01-01")), (F.col("n_nationkey") * 30).cast("int")).alias("expires_on"),
    )
    repo_id = F.when(F.col("c_acctbal") < -950, F.col("c_name")).otherwise(
        F.regexp_replace("c_name", "#", "-"))
    repos = cust.where(F.col("c_custkey") % 10 != 0).select(
        F.concat(F.lit("nat-"), F.col("c_nationkey").cast("string")).alias("engagement_id"),
        F.col("c_custkey").alias("pos"),
        repo_id.alias("repository_id"),
        F.concat(F.lit("/repos/"), F.col("c_custkey").cast("string")).alias("path"),
        F.split(F.concat_ws(",", F.lit("repository-policy"), F.lower("c_mktsegment")), ",").alias("allowed_checks"),
    )
    return sc, repos


def scope_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One authorization request per order for its customer's repository;
    every seventh order names another checkout path; the check is the
    customer segment or, for urgent orders, a check nobody lists."""
    orders = table(spark, sf_dir, "orders")
    cust = table(spark, sf_dir, "customer")
    j = orders.join(cust, orders.o_custkey == cust.c_custkey)
    repo_id = F.when(F.col("c_acctbal") < -950, F.col("c_name")).otherwise(F.regexp_replace("c_name", "#", "-"))
    return j.select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("nat-"), F.col("c_nationkey").cast("string")).alias("engagement_id"),
        repo_id.alias("repository_id"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("/elsewhere")).otherwise(
            F.concat(F.lit("/repos/"), F.col("c_custkey").cast("string"))).alias("path"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("osv")).otherwise(F.lower("c_mktsegment")).alias("check"),
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs plus loopback variants derived from them."""
    pages = table(spark, sf_dir, "pages")
    forms = F.element_at(F.array(*[F.lit(x) for x in (
        "http://localhost:8080/v1", "https://127.0.0.1/v1", "http://[::1]:11434/v1",
        "http://LocalHost/v1", "ftp://localhost/v1", "http://127.0.0.256/v1", "http://user@127.1.2.3:99/x",
        "localhost/v1")]), (F.col("page_id") % 8 + 1).cast("int"))
    return pages.select(F.col("page_id").cast("string").alias("url_id"), F.col("url")).unionByName(
        pages.select(F.concat(F.lit("lo-"), F.col("page_id").cast("string")).alias("url_id"), forms.alias("url")))


# ------------------------------------------------------------ events-derived views
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows before hashing: chain = user, seq = event id."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("chain"), F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_type").alias("event"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"),
        F.create_map(F.lit("props"), F.col("props")).alias("details"),
    )


# Event type → workflow state of the transition fixture.
EVENT_STATE = (("signup", "received"), ("view", "pending_approval"), ("click", "approved"),
               ("purchase", "published"), ("error", "failed"))


def _event_state(col: str = "event_type"):
    return F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_STATE for x in kv]), F.col(col))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"),
                     F.col("event_id").alias("seq"), _event_state().alias("to_state"))


def state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workflow state table: one row per user, state = the state of the
    user's last event; fingerprints from the user id; receipts for published
    cases."""
    ev = table(spark, sf_dir, "events")
    last = ev.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("_last"),
                                     F.max("event_id").alias("updated_seq"))
    case_id = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    st = _event_state("_last")
    return last.select(
        case_id.alias("case_id"),
        F.sha2(F.concat(F.lit("case:"), F.col("user_id").cast("string")), 256).alias("case_fingerprint"),
        st.alias("state"),
        F.element_at(F.array(*[F.lit(r) for r in ("low", "medium", "high", "critical")]),
                     (F.col("user_id") % 4 + 1).cast("int")).alias("risk"),
        F.sha2(F.concat(F.lit("assessment:"), F.col("user_id").cast("string")), 256).alias("assessment_fp"),
        F.when(st.isin("approved", "published"), F.concat(F.lit("rev-"), (F.col("user_id") % 5).cast("string"))).alias("reviewer"),
        F.when(st == "published", F.concat(F.lit("file:handoff/approved-"),
                                           F.substring(F.sha2(case_id, 256), 1, 20), F.lit(".json"))).alias("receipt"),
        F.col("updated_seq"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider attempts: case = user, attempt = 1-based event order,
    error → transient, purchase → permanent, else success."""
    from pyspark.sql import Window
    ev = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return ev.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("case_id"),
        F.row_number().over(w).alias("attempt"),
        F.when(F.col("event_type") == "error", F.lit("transient"))
        .when(F.col("event_type") == "purchase", F.lit("permanent")).otherwise(F.lit("success")).alias("outcome"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case submissions: case = customer, seq = order, content = priority and
    status."""
    from ..functions.hashing import fingerprint
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("case_id"),
                    F.col("o_orderkey").alias("seq"),
                    fingerprint("o_orderpriority", "o_orderstatus").alias("fingerprint"))


def submission_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions whose content is the order's status, with what their analysis
    gives: failed for every third order key, rejected for every seventh of the others."""
    from ..functions.hashing import fingerprint
    o = table(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderkey") % 3 == 0, F.lit("failed")).when(F.col("o_orderkey") % 7 == 0, F.lit("rejected")).otherwise(F.lit("success"))
    return o.select(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("case_id"),
                    F.col("o_orderkey").alias("seq"), fingerprint("o_orderstatus").alias("fingerprint"), outcome.alias("outcome"))


def provider_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider attempts of the conversation cases: one for each turn; a fifth of
    the cases have none."""
    c = table(spark, sf_dir, "conversations").where(F.col("conv_id") % 5 != 4)
    k = (F.col("conv_id") * 3 + F.col("turn")) % 4
    return c.select(F.col("conv_id").cast("string").alias("case_id"), (F.col("turn") + 1).alias("attempt"),
                    F.when(k < 2, F.lit("transient")).when(k == 2, F.lit("success")).otherwise(F.lit("permanent")).alias("outcome"),
                    F.concat(F.lit("no answer for "), "role").alias("reason"))


def submission_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records for every fifth customer (every tenth failed)."""
    from ..functions.hashing import fingerprint
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 5 == 0)
    return c.select(F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("case_id"),
                    fingerprint(F.lit("1-URGENT"), F.lit("O")).alias("case_fingerprint"),
                    F.when(F.col("c_custkey") % 10 == 0, F.lit("failed")).otherwise(F.lit("pending_approval")).alias("state"))


# ------------------------------------------------------------ predictions
N_CLASSES = 10


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("key"),
                    F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), "embedding")


def token_groups(run: str = "a"):
    """Class c is read from tokens (c, c+10) in run a and (c+20, c+30) in
    run b."""
    off = 0 if run == "a" else 20
    return [[c + off, c + off + 10] for c in range(N_CLASSES)]


CLASS_NAMES = tuple(f"c{i}" for i in range(N_CLASSES))


def predictions(spark: SparkSession, sf_dir: str, run: str = "a") -> DataFrame:
    from ..operators.triage import constrained_classify
    p = constrained_classify(logits(spark, sf_dir), "embedding", token_groups(run), CLASS_NAMES)
    return p.select("key", "label", "pred", "confidence", (F.col("pred") == F.col("label")).alias("correct"),
                    F.col("free_top_is_class").alias("free_top_is_letter"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with many confidence ties: correct = value > 50,
    confidence = (user % 100) / 100, tie-break = event id."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("key"), (F.col("value") > 50).alias("correct"),
                     ((F.col("user_id") % 100) / 100.0).alias("confidence"))


def doc_manifest(spark: SparkSession, sf_dir: str):
    """manifest / actual over documents: 5 % absent from the manifest,
    10 % absent on disk, 10 % altered."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    split = F.when(F.col("doc_id") % 10 < 7, F.lit("train")).when(F.col("doc_id") % 10 == 7, F.lit("val")).otherwise(F.lit("test"))
    manifest = d.where(F.col("doc_id") % 20 != 0).select(
        path.alias("path"), F.col("lang").alias("label"), split.alias("split"),
        F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    actual = d.where(F.col("doc_id") % 10 != 3).select(
        path.alias("path"),
        F.when(F.col("doc_id") % 10 == 7, F.sha2(F.concat("text", F.lit("!")), 256))
        .otherwise(F.sha2("text", 256)).alias("sha256"))
    return manifest, actual


# ------------------------------------------------------------ measurements
def measurement_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("img_P"), F.col("l_partkey").cast("string"), F.lit("x.png"))) \
        .otherwise(F.format_string("d%d_a%d_%s_r%d-%d-%d_P%dx.png", (F.col("l_orderkey") % 900 + 100),
                                   (F.col("l_linenumber") * 15 % 90),
                                   F.when(F.col("l_returnflag") == "A", F.lit("lamp")).otherwise(F.lit("sun")),
                                   F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")))
    return li.select(name.alias("image"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("measured_mm"))


def measurement_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("x")).alias("object"),
                    F.col("p_retailprice").alias("true_mm"), F.col("p_partkey").alias("truth_pos"))


def _emb(i: int):
    return F.col("embedding")[i].cast("double")


def plane_points(spark: SparkSession, sf_dir: str):
    e = table(spark, sf_dir, "embeddings")
    h = F.array(F.lit(1.0) + _emb(0) * 0.01, _emb(1) * 0.01, _emb(2), _emb(3) * 0.01, F.lit(1.0) + _emb(4) * 0.01,
                _emb(5), _emb(6) * 0.001, _emb(7) * 0.001, F.lit(1.0))
    homs = e.select(F.col("vec_id").alias("image"), h.alias("h"))
    pts = e.select(F.col("vec_id").alias("image"), (_emb(10) * 100 + 500).alias("x1"), (_emb(11) * 100 + 500).alias("y1"),
                   (_emb(12) * 100 + 500).alias("x2"), (_emb(13) * 100 + 500).alias("y2"))
    return pts, homs


def reprojection(spark: SparkSession, sf_dir: str):
    e = table(spark, sf_dir, "embeddings")
    obs = e.select(F.col("label").alias("view"), F.col("vec_id").alias("corner"), _emb(0).alias("x"), _emb(1).alias("y"))
    prj = e.select(F.col("label").alias("view"), F.col("vec_id").alias("corner"),
                   (_emb(0) + _emb(2) * 0.01).alias("x"), (_emb(1) + _emb(3) * 0.01).alias("y"))
    return obs, prj


# ------------------------------------------------------------ model responses
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output text per (conversation, turn): turn 0 of every fourth
    conversation is not JSON, turn 1 lacks citations; confidence is a number,
    a quoted number or a word; some summaries and labels make banned claims."""
    from ..functions.text import json_string
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    risk = F.get(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical", "severe")]), (k % 5).cast("int"))
    summary = F.when(k % 6 == 0, F.lit("The system is compliant with policy.")).otherwise(F.col("text"))
    labels = F.when(k % 7 == 0, F.lit('["review","Certified "]')).otherwise(
        F.concat(F.lit("["), json_string(F.col("role")), F.lit("]")))
    cites = F.concat(F.lit('[{"source_id":'), json_string(F.col("turn").cast("string")), F.lit(',"quote":'),
                     json_string(F.substring("text", 3, 25)), F.lit("}]"))
    conf = (F.when(F.col("turn") % 3 == 0, F.format_string("%d.5", (k % 2)))
            .when(F.col("turn") % 3 == 1, F.format_string('"0.%d"', (k % 10)))
            .otherwise(F.lit('"high"')))
    body = F.concat(F.lit('{"risk":'), json_string(risk), F.lit(',"summary":'), json_string(summary),
                    F.lit(',"labels":'), labels,
                    F.when(F.col("turn") != 1, F.concat(F.lit(',"citations":'), cites)).otherwise(F.lit("")),
                    F.lit(',"confidence":'), conf, F.lit("}"))
    content = F.when((F.col("turn") == 0) & (F.col("conv_id") % 4 == 0), F.col("text")).otherwise(body)
    return c.select(F.col("conv_id").cast("string").alias("case_id"), (F.col("turn") + 1).alias("attempt"),
                    content.alias("content"))


# ------------------------------------------------------------ files of other systems
def foreign_audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, pos, value): one audit file for each conversation as another system writes it, a
    JSON line for each turn with nested details, chained by SHA-256.  In some files the
    first line's text was changed afterwards, others end in a line that is no JSON."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")

    def write(pdf):
        import hashlib
        import json

        import pandas as pd
        rows, previous, conv = [], "0" * 64, int(pdf["conv_id"].iloc[0])
        for i, r in enumerate(pdf.sort_values("turn").itertuples(index=False)):
            record = {"timestamp": f"2024-01-01T00:00:{i:02d}+00:00", "event": r.role, "case_id": str(conv), "previous_hash": previous,
                      "details": {"text": r.text, "turn": int(r.turn), "nested": {"b": [1, 2.5, None], "a": {"é": True, "\"": "\\"}}}}
            previous = hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
            if conv % 7 == 3 and i == 0:
                record["details"]["text"] += "!"
            rows.append((conv, i, json.dumps(record | {"event_hash": previous}, sort_keys=True)))
        if conv % 11 == 5:
            rows.append((conv, len(rows), "not-json"))
        return pd.DataFrame(rows, columns=["conv_id", "pos", "value"])

    return c.groupBy("conv_id").applyInPandas(write, "conv_id long, pos long, value string")


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each long lower-case word of the benchmark texts: the word and the letters after it."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).distinct()
    return words.where(F.col("w").rlike("^[a-z]{8,}$")).select(
        F.concat(F.lit("word-"), "w").alias("rule_id"), F.concat("w", F.lit("[a-z]*")).alias("pattern"), F.lit("low").alias("severity"),
        F.concat(F.lit("contains "), "w").alias("message"), F.col("w").alias("literal"))
