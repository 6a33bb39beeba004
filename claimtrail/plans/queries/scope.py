"""Registered queries, group C (scope): C1_validate_scope, C2_authorize, C3_egress_allowed, C4_check_coverage."""

from ._shared import *  # noqa: F401,F403
from ._shared import register  # noqa: F401


@register("C1_validate_scope", f"""
WITH {_SCOPES_SQL},
  st AS (SELECT engagement_id, count(*) AS n, count(DISTINCT repository_id) AS nd,
                max(CASE WHEN regexp_full_match(repository_id, '[A-Za-z0-9._-]+') THEN 0 ELSE 1 END) AS bad
         FROM sr GROUP BY engagement_id)
SELECT engagement_id,
       CASE WHEN version <> 1 THEN 'scope version must be 1'
            WHEN egress NOT IN ('deny', 'local-only', 'allow') THEN 'egress must be deny, local-only, or allow'
            WHEN coalesce(n, 0) = 0 THEN 'scope must authorize at least one repository'
            WHEN bad = 1 THEN 'repository_id contains unsupported characters'
            WHEN nd <> n THEN 'repository_id values must be unique' END AS reason
FROM sc LEFT JOIN st USING (engagement_id)
""")
def q_c1(spark, sf_dir):
    sc, repos = fixtures.scopes(spark, sf_dir)
    return scope.validate_scope(sc, repos)


@register("C2_authorize", f"""
WITH {_SCOPES_SQL},
  rq AS (SELECT o_orderkey AS request_id, 'nat-' || CAST(c_nationkey AS VARCHAR) AS engagement_id,
                CASE WHEN c_acctbal < -950 THEN c_name ELSE replace(c_name, '#', '-') END AS repository_id,
                CASE WHEN o_orderkey % 7 = 0 THEN '/elsewhere' ELSE '/repos/' || CAST(c_custkey AS VARCHAR) END AS path,
                CASE WHEN o_orderpriority = '1-URGENT' THEN 'osv' ELSE lower(c_mktsegment) END AS chk
         FROM orders JOIN customer ON o_custkey = c_custkey),
  j AS (SELECT rq.request_id,
          CASE WHEN sc.expires_on IS NULL OR sc.expires_on < DATE '2030-06-01' THEN 'pilot authorization has expired'
               WHEN sr.repository_id IS NULL THEN 'repository is outside pilot scope: ' || rq.repository_id
               WHEN sr.path <> rq.path THEN 'repository path does not match the authorized checkout'
               WHEN NOT list_contains(sr.allowed_checks, rq.chk) THEN 'check is outside pilot scope: ' || rq.chk
          END AS reason
        FROM rq LEFT JOIN sc USING (engagement_id)
                LEFT JOIN sr ON sr.engagement_id = rq.engagement_id AND sr.repository_id = rq.repository_id)
SELECT request_id, reason IS NULL AS allowed, reason FROM j
""")
def q_c2(spark, sf_dir):
    sc, repos = fixtures.scopes(spark, sf_dir)
    return scope.authorize(fixtures.scope_requests(spark, sf_dir), sc, repos, as_of="2030-06-01")


@register("C3_egress_allowed", f"""
WITH urls0 AS (SELECT CAST(page_id AS VARCHAR) AS url_id, url FROM pages
               UNION ALL
               SELECT 'lo-' || CAST(page_id AS VARCHAR),
                      (['http://localhost:8080/v1', 'https://127.0.0.1/v1', 'http://[::1]:11434/v1',
                        'http://LocalHost/v1', 'ftp://localhost/v1', 'http://127.0.0.256/v1',
                        'http://user@127.1.2.3:99/x', 'localhost/v1'])[page_id % 8 + 1] FROM pages),
  {_HOST_SQL}
SELECT url_id, url, host,
       coalesce(scheme IN ('http', 'https') AND host IS NOT NULL AND
                (host = 'localhost' OR regexp_matches(host, '{scope.IPV4_LOOPBACK}')
                 OR regexp_matches(host, '{scope.IPV6_LOOPBACK}')), false) AS allowed
FROM u3
""")
def q_c3(spark, sf_dir):
    return scope.egress_allowed(fixtures.urls(spark, sf_dir), "deny").select("url_id", "url", "host", "allowed")


@register("C4_check_coverage", f"""
WITH rq AS (SELECT DISTINCT o_custkey AS request_id, {_REQ_CHECK} AS chk FROM orders),
  unk AS (SELECT request_id, string_agg(chk, ', ' ORDER BY chk) AS u
          FROM (SELECT DISTINCT request_id, chk FROM rq
                WHERE chk NOT IN ('repository-policy', 'semgrep', 'gitleaks', 'osv')) GROUP BY request_id)
SELECT c_custkey AS request_id, coalesce(unk.u, '') AS unknown_checks,
       CASE WHEN unk.u IS NOT NULL THEN 'unsupported checks: ' || unk.u
            WHEN c_custkey NOT IN (SELECT request_id FROM rq) THEN 'at least one check is required' END AS reason
FROM customer LEFT JOIN unk ON unk.request_id = c_custkey
""")
def q_c4(spark, sf_dir):
    orders = fixtures.table(spark, sf_dir, "orders")
    requested = orders.select(F.col("o_custkey").alias("request_id"), F.expr(_REQ_CHECK).alias("check"))
    requests = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"))
    return scope.check_coverage(requests, requested)
