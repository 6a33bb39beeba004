"""Pilot scope, authorization and egress policy.

Scopes are kept in long form: ``scopes(engagement_id, version, egress,
customer, expires_on date)`` and ``scope_repos(engagement_id, pos,
repository_id, path, allowed_checks array<string>)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import first_failing

# Scope rules.
EGRESS_MODES = ("deny", "local-only", "allow")
REPOSITORY_ID_PATTERN = r"^[A-Za-z0-9._-]+$"
# The checks the pilot command knows.
SUPPORTED_CHECKS = ("repository-policy", "semgrep", "gitleaks", "osv")
# Reasons, which results must equal.
MSG_VERSION = "scope version must be 1"
MSG_EGRESS = "egress must be deny, local-only, or allow"
MSG_NO_REPOSITORY = "scope must authorize at least one repository"
MSG_ID_CHARACTERS = "repository_id contains unsupported characters"
MSG_ID_UNIQUE = "repository_id values must be unique"
MSG_EXPIRED = "pilot authorization has expired"
MSG_REPOSITORY_OUTSIDE = "repository is outside pilot scope: "
MSG_PATH = "repository path does not match the authorized checkout"
MSG_CHECK_OUTSIDE = "check is outside pilot scope: "


def validate_scope(scopes: DataFrame, scope_repos: DataFrame) -> DataFrame:
    """(engagement_id, reason) — version 1, known egress mode, at least
    one repository, ids of ``[A-Za-z0-9._-]+``, unique ids."""
    st = scope_repos.groupBy("engagement_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_distinct("repository_id").alias("_nd"),
        F.max((~F.coalesce(F.col("repository_id").rlike(REPOSITORY_ID_PATTERN), F.lit(False))).cast("int")).alias("_bad"),
    )
    j = scopes.join(st, "engagement_id", "left")
    n = F.coalesce("_n", F.lit(0))
    reason = first_failing(
        (F.coalesce(F.col("version") != 1, F.lit(True)), MSG_VERSION),
        (~F.coalesce(F.col("egress").isin(*EGRESS_MODES), F.lit(False)), MSG_EGRESS),
        (n == 0, MSG_NO_REPOSITORY),
        (F.col("_bad") == 1, MSG_ID_CHARACTERS),
        (F.col("_nd") != n, MSG_ID_UNIQUE),
    )
    return j.select("engagement_id", reason.alias("reason"))


def authorize(requests: DataFrame, scopes: DataFrame, scope_repos: DataFrame, as_of: str) -> DataFrame:
    """requests(request_id, engagement_id, repository_id, path, check) →
    (request_id, allowed, reason): the first failing of expired (strictly
    before ``as_of``), unknown repository, path mismatch, check not listed.

    Two equi-joins; Spark broadcasts the scope side only when its measured
    size is under the broadcast threshold."""
    s = scopes.select("engagement_id", F.col("expires_on").alias("_exp"))
    r = scope_repos.select("engagement_id", "repository_id", F.col("path").alias("_path"),
                           F.col("allowed_checks").alias("_checks"), F.lit(True).alias("_known"))
    j = requests.join(s, "engagement_id", "left").join(r, ["engagement_id", "repository_id"], "left")
    reason = first_failing(
        (F.coalesce(F.col("_exp") < F.to_date(F.lit(as_of)), F.lit(True)), MSG_EXPIRED),
        (F.col("_known").isNull(), F.concat(F.lit(MSG_REPOSITORY_OUTSIDE), F.col("repository_id"))),
        (F.col("_path") != F.col("path"), MSG_PATH),
        (~F.array_contains("_checks", F.col("check")), F.concat(F.lit(MSG_CHECK_OUTSIDE), F.col("check"))),
    )
    return j.select("request_id", reason.isNull().alias("allowed"), reason.alias("reason"))


def url_host(url) -> Column:
    """Host of an absolute URL as ``urlparse(...).hostname`` gives it:
    userinfo and port removed, brackets of IPv6 literals stripped,
    lower-cased; null when there is no authority."""
    c = F.col(url) if isinstance(url, str) else url
    netloc = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    hostport = F.regexp_replace(netloc, r"^.*@", "")
    host = F.when(hostport.startswith("["), F.regexp_extract(hostport, r"^\[([^\]]*)\]", 1)) \
        .otherwise(F.regexp_replace(hostport, r":[^:]*$", ""))
    return F.when(host != "", F.lower(host))


def url_scheme(url) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


IPV4_LOOPBACK = r"^127\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
IPV6_LOOPBACK = r"^(0{0,4}:){2,7}0{0,3}1$|^::1$|^(0{1,4}:){7}0{0,3}1$"


def is_loopback_host(host) -> Column:
    h = F.col(host) if isinstance(host, str) else host
    return (h == "localhost") | h.rlike(IPV4_LOOPBACK) | h.rlike(IPV6_LOOPBACK)


def egress_allowed(urls: DataFrame, egress, url: str = "url") -> DataFrame:
    """``egress`` (a column or a mode) ``allow`` permits everything;
    otherwise only an http(s) URL whose host is localhost or a loopback IP."""
    mode = F.lit(egress) if isinstance(egress, str) else egress
    host = url_host(url)
    ok = (mode == "allow") | (url_scheme(url).isin("http", "https") & host.isNotNull()
                              & F.coalesce(is_loopback_host(host), F.lit(False)))
    reason = (F.when(ok, F.lit(None))
              .when(~url_scheme(url).isin("http", "https") | host.isNull(),
                    F.lit("provider URL must be an absolute HTTP(S) URL"))
              .otherwise(F.lit("scope permits local model endpoints only")))
    return urls.withColumn("host", host).withColumn("allowed", F.coalesce(ok, F.lit(False))) \
        .withColumn("reason", reason)


def check_coverage(requests: DataFrame, requested: DataFrame,
                   supported: Sequence[str] = SUPPORTED_CHECKS) -> DataFrame:
    """C4: requests(request_id) and requested(request_id, check) → per
    request the sorted unknown checks and the error (unknown checks first,
    then an empty request)."""
    sup = F.array(*[F.lit(s) for s in supported])
    unknown = requested.where(~F.array_contains(sup, F.col("check"))).groupBy("request_id").agg(
        F.array_sort(F.collect_set("check")).alias("_unknown"))
    n = requested.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    j = requests.select("request_id").join(unknown, "request_id", "left").join(n, "request_id", "left")
    joined = F.array_join("_unknown", ", ")
    reason = first_failing(
        (F.col("_unknown").isNotNull(), F.concat(F.lit("unsupported checks: "), joined)),
        (F.coalesce("_n", F.lit(0)) == 0, "at least one check is required"),
    )
    return j.select("request_id", F.coalesce(joined, F.lit("")).alias("unknown_checks"), reason.alias("reason"))
