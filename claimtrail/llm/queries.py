"""The ``opN_*`` queries: each applies its operator to the whole of ``documents``
and derives the digest columns of its result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from . import bpe, exact, fmindex, mixing, oph, quality, repair, resample, secrets, simhash, suffix, toxicity, wordbpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir), VOCABULARY, PATTERN)
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = toxicity.sample(docs, table(spark, sf_dir, "labels"), train=~held_out)
    scored = toxicity.score(docs, toxicity.learn(rows))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                         F.size("hits").cast("long").alias("n_hits"))


def encoded(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs, VOCABULARY, PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))


@query
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return oph.compare_edited(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.removed(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.assign(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, "score").select(
        "doc_id", "score", (F.col("score") >= quality.THRESHOLD).alias("accepted"))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.assign(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLES["op10_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.round_trip(documents(spark, sf_dir), TOKENIZER, PATTERN).select(
        "doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(talks), originals=talks)


_CRC = """xor(list_reduce({bytes},
           lambda c, b: list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)),
           4294967295), 4294967295)"""      # CRC-32 of a list of bytes, bit by bit

ORACLES["op11_resample"] = r"""
WITH words AS (
  SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS rid FROM documents
  UNION ALL
  SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), NULL FROM benchmark),
each AS (SELECT side, rid, unnest(w) AS word FROM words),
tallied AS (SELECT side, rid, word, count(*) AS n FROM each GROUP BY ALL),
crc AS (
  SELECT word, @CRC@ % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM tallied)),
bucketed AS (SELECT side, rid, bucket, sum(n) AS n FROM tallied JOIN crc USING (word) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM bucketed),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(sum(n) FILTER (WHERE side = 1), 0) + 1) * (any_value(totals.s) + 10000) AS DOUBLE)
                                              / ((coalesce(sum(n) FILTER (WHERE side = 0), 0) + 1) * (any_value(totals.t) + 10000)))) AS BIGINT) AS gain
          FROM bucketed, totals GROUP BY bucket),
weights AS (SELECT rid, sum(n) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
            FROM bucketed JOIN gains USING (bucket) WHERE side = 0 GROUP BY rid),
scored AS (SELECT doc_id, rid, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                                  / 4294967296))) AS BIGINT) AS score
           FROM words LEFT JOIN weights USING (rid) WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place, count(*) OVER () AS n
           FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
""".replace("@CRC@", _CRC.format(
    bytes="[CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT) FOR i IN range(octet_length(encode(word)))]"))

ORACLES["op13_repair"] = """
WITH RECURSIVE plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS spelt FROM conversations),
kinds AS (
  SELECT spelt, @CRC@ % 20 AS kind
  FROM (SELECT DISTINCT spelt FROM plain)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM plain JOIN kinds USING (spelt), range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
faulty AS (
  SELECT conv_id, turn, role, text, pos, substr(role, 1, 1) AS initial, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
marked AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM faulty),
-- states: 0 nothing yet, 1 after s, 2 after u, 3 after ua; one row of the talk after the other, insertions between them
moves AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) m(p, x, q)),
closure AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 2, 5, 'I'),
                                  (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I')) c(p, q, cost, audit)),
talk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, q AS state, CAST(cost AS BIGINT) AS cost, audit, [] :: STRUCT(r VARCHAR, x VARCHAR)[] AS rows
  FROM marked, closure WHERE p = 0
  UNION ALL
  SELECT conv_id, pos, state, best.cost, best.audit, best.rows FROM (
    SELECT t.conv_id, m.pos, c.q AS state, min({'cost': t.cost + e.cost + c.cost, 'audit': t.audit || e.audit || c.audit, 'rows': t.rows || e.rows ||
             CASE c.audit WHEN 'I' THEN CASE c.q WHEN 2 THEN [{'r': 'user', 'x': ''}] ELSE [{'r': 'assistant', 'x': ''}] END
                          WHEN 'II' THEN [{'r': 'user', 'x': ''}, {'r': 'assistant', 'x': ''}] ELSE [] END}) AS best
    FROM talk t JOIN marked m ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.pos = t.pos + 1,
    LATERAL (SELECT t.state AS q, 2 AS cost, 'D' AS audit, [] :: STRUCT(r VARCHAR, x VARCHAR)[] AS rows
             UNION ALL SELECT q, CASE m.fault WHEN 't' THEN 5 ELSE 0 END, 'K', [{'r': m.role, 'x': m.text}] FROM moves
                       WHERE p = t.state AND x = m.initial AND m.fault NOT IN ('b', 'd')
             UNION ALL SELECT q, CASE m.fault WHEN 't' THEN 6 ELSE 1 END, 'R', [{'r': CASE x WHEN 'u' THEN 'user' ELSE 'assistant' END, 'x': m.text}] FROM moves
                       WHERE p = t.state AND x IN ('u', 'a') AND m.fault NOT IN ('b', 'd')) e
    JOIN closure c ON c.p = e.q GROUP BY t.conv_id, m.pos, c.q)),
counted AS (
  SELECT conv_id, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
ended AS (SELECT t.conv_id, min({'cost': t.cost, 'audit': t.audit, 'rows': t.rows}) AS best
          FROM talk t JOIN counted n ON n.conv_id IS NOT DISTINCT FROM t.conv_id AND n.n = t.pos WHERE state IN (0, 3) GROUP BY t.conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string([r.r || ':' || r.x FOR r IN best.rows], chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
""".replace("@CRC@", _CRC.format(bytes="[CAST(ascii(substr(spelt, i, 1)) AS BIGINT) FOR i IN range(1, length(spelt) + 1)]"))
