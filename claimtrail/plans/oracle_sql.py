"""DuckDB SQL for each registered query (the driver's correctness oracle).

Written independently from the Spark code: each statement restates the
operator's semantics over the driver's tables.  Shared fragments are the
fixed patterns below.
"""

from __future__ import annotations

from ..functions.text import BLANK_PATTERN, LINE_BREAK

BLANK = BLANK_PATTERN.replace("'", "''")
LB = LINE_BREAK.replace("'", "''")


def blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_matches({x}, '{BLANK}'))"


def first_line(x: str, n: int = 240) -> str:
    return f"substring(regexp_split_to_array({x}, '{LB}')[1], 1, {n})"


CONV_SOURCES = """
  src AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, turn AS pos,
                 CAST(turn AS VARCHAR) AS source_id, text FROM conversations),
  hdr AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS case_id,
                 'conversation ' || CAST(conv_id AS VARCHAR) AS title FROM conversations)"""

CONV_ROLE_SOURCES = """
  src AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, turn AS pos,
                 role AS source_id, text FROM conversations),
  hdr AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS case_id,
                 'conversation ' || CAST(conv_id AS VARCHAR) AS title FROM conversations)"""


def e1_reason(max_chars: int = 100_000) -> str:
    return f"""
  st AS (SELECT case_id, count(*) AS n, count(DISTINCT source_id) AS nd,
                max(CASE WHEN {blank('source_id')} THEN 1 ELSE 0 END) AS bid,
                max(CASE WHEN {blank('text')} THEN 1 ELSE 0 END) AS btx,
                sum(length(text)) AS tot
         FROM src GROUP BY case_id),
  e1 AS (SELECT h.case_id,
           CASE WHEN {blank('h.case_id')} THEN 'case_id is required'
                WHEN {blank('h.title')} THEN 'title is required'
                WHEN coalesce(st.n, 0) = 0 THEN 'at least one evidence source is required'
                WHEN st.bid = 1 THEN 'source_id is required'
                WHEN st.nd <> st.n THEN 'source_id values must be unique'
                WHEN st.btx = 1 THEN 'evidence text cannot be empty'
                WHEN st.tot > {max_chars} THEN 'evidence exceeds the configured size limit'
           END AS reason
         FROM hdr h LEFT JOIN st USING (case_id))"""


def tier_case(tiers) -> str:
    parts = []
    order = {"low": 0, "medium": 1, "high": 2, "critical": 3}
    for risk, words in tiers:
        cond = " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in words)
        parts.append(f"WHEN {cond} THEN {order[risk]}")
    return "CASE " + " ".join(parts) + " ELSE 0 END"


RISK_NAME = "(['low','medium','high','critical'])[{x} + 1]"


def canon(x: str) -> str:
    return f"coalesce(CAST(length(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '~')"


def sev_rank(x: str) -> str:
    return (f"CASE {x} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 "
            f"WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 2 END")


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')"


def obs_json(p: str = "") -> str:
    fields = ["check", "message", "observation_id", "path", "severity", "status"]
    parts = []
    for i, f in enumerate(fields):
        parts.append(("'{" if i == 0 else "', ") + f'"{f}": ' + "'")
        parts.append(f'CAST(to_json({p}"{f}") AS VARCHAR)')
    return " || ".join(parts) + " || '}'"


OBS = """
  obs AS (SELECT 'eng-1' AS engagement_id, 'repo-' || CAST(l_suppkey AS VARCHAR) AS repository_id,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos,
           CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR)
             AS observation_id,
           'flag-' || l_returnflag AS "check",
           CASE WHEN l_discount >= 0.05::DOUBLE THEN 'review' ELSE 'pass' END AS status,
           CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'critical'
                WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'high'
                WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'medium'
                WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'low'
                WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'info'
                WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'unknown' END AS severity,
           'part/' || CAST(l_partkey AS VARCHAR) AS path,
           'quantity ' || CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR) || ' "units"' AS message,
           l_suppkey
         FROM lineitem)"""

REPORTS = """
  reports AS (SELECT 'eng-1' AS engagement_id, 'repo-' || CAST(s_suppkey AS VARCHAR) AS repository_id FROM supplier
              UNION ALL
              SELECT 'eng-1', 'nation-' || CAST(n_nationkey AS VARCHAR) FROM nation)"""


def selected(max_items: int = 100, max_chars: int = 90000) -> str:
    return f"""
  ranked AS (SELECT *, {obs_json()} AS text,
               row_number() OVER (PARTITION BY engagement_id, repository_id
                                  ORDER BY {sev_rank('severity')}, observation_id) AS rn
             FROM obs),
  capped AS (SELECT *, sum(length(text)) OVER (PARTITION BY engagement_id, repository_id ORDER BY rn
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chars
             FROM ranked WHERE rn <= {max_items}),
  sel AS (SELECT * FROM capped WHERE chars <= {max_chars})"""


def merkle(src: str, keys: str, pos: str, digest: str, block: int = 4096) -> str:
    """One block level then the top, as functions.hashing.ordered_digest."""
    return f"""
  m1 AS (SELECT {keys}, {pos} // {block} AS p, sha256(string_agg({digest}, '' ORDER BY {pos})) AS d
         FROM {src} GROUP BY {keys}, {pos} // {block}),
  mtop AS (SELECT {keys}, sha256(string_agg(d, '' ORDER BY p)) AS tree FROM m1 GROUP BY {keys})"""


def record_canon_sql() -> str:
    """Canonical audit record (case_id, details, event, seq, ts_us)."""
    det = "'1#' || " + canon("'props'") + " || " + canon("props")
    return " || ".join([canon("case_id"), canon(f"({det})"), canon("event"), canon("seq"), canon("ts_us")])


AUDIT = f"""
  aud AS (SELECT user_id AS chain, event_id AS seq, epoch_us(ts) AS ts_us, event_type AS event,
                 'user-' || CAST(user_id AS VARCHAR) AS case_id, props,
                 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
          FROM events),
  audc AS (SELECT *, {{rc}} AS c FROM aud),
  chainh(chain, rn, seq, prev, h) AS (
    SELECT chain, rn, seq, repeat('0', 64), sha256(c || '64:' || repeat('0', 64)) FROM audc WHERE rn = 1
    UNION ALL
    SELECT a.chain, a.rn, a.seq, ch.h, sha256(a.c || '64:' || ch.h)
    FROM audc a JOIN chainh ch ON a.chain = ch.chain AND a.rn = ch.rn + 1)""".replace("{rc}", record_canon_sql())

from ..functions.text import STRIP_PATTERN, WS_RUN_PATTERN  # noqa: E402

STRIP = STRIP_PATTERN.replace("'", "''")
WS_RUN = WS_RUN_PATTERN.replace("'", "''")
