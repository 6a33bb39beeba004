"""B1 fingerprints and B2 idempotency keys.

Canonical form (ours, injective, reproducible in any SQL engine): every value
is written as ``<length>:<text>``; null is ``~``; integers and booleans are
written as decimal text first, timestamps as epoch microseconds.  A record is
the concatenation of its fields in a fixed (sorted) name order.  The digest is
SHA-256 in lower-case hex.

Ordered collections (the sources of a case, the observations of a report) are
digested as a ``block``-ary Merkle tree over their dense position column, so
no single group is ever gathered whole: the leaf level groups at most
``block`` positions, the top level at most ``n / block**levels`` digests.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_TOKEN = "~"
MERKLE_BLOCK = 4096
MERKLE_LEVELS = 1      # a key of a billion rows leaves 244,000 block digests (16 MB) for the top


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canon(x) -> Column:
    """``<length>:<value>`` of one value cast to text; null → ``~``."""
    s = _c(x).cast("string")
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit(NULL_TOKEN))


def canon_record(*cols) -> Column:
    return F.concat(*[canon(c) for c in cols])


def fingerprint(*cols) -> Column:
    """B1 for a flat record: SHA-256 of the canonical form of ``cols``."""
    return F.sha2(canon_record(*cols), 256)


def idempotency_key(case_fp, assessment_fp) -> Column:
    """B2: ``<case fingerprint>:<assessment fingerprint>``."""
    return F.concat_ws(":", _c(case_fp), _c(assessment_fp))


def _ordered_concat(pos: str, digest: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(digest).alias("d"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda e: e["d"]), ""), 256)


def ordered_digest(df: DataFrame, keys: Iterable[str], pos: str, digest: str,
                   block: int = MERKLE_BLOCK, levels: int = MERKLE_LEVELS,
                   out: str = "digest") -> DataFrame:
    """Digest of the sequence of ``digest`` values per ``keys`` in ``pos``
    order, as a Merkle tree over position blocks.

    Every level is a partial-aggregate-free group of at most ``block`` rows
    per (key, block), so skewed keys are split across tasks.
    """
    keys = list(keys)
    cur = df.select(*keys, F.col(pos).cast("bigint").alias("_p"), F.col(digest).alias("_d"))
    for _ in range(levels):
        cur = (
            cur.withColumn("_b", F.floor(F.col("_p") / F.lit(block)).cast("bigint"))
            .groupBy(*keys, "_b")
            .agg(_ordered_concat("_p", "_d").alias("_d"))
            .withColumnRenamed("_b", "_p")
        )
    return cur.groupBy(*keys).agg(_ordered_concat("_p", "_d").alias(out))


def case_fingerprints(headers: DataFrame, sources: DataFrame,
                      block: int = MERKLE_BLOCK, levels: int = MERKLE_LEVELS) -> DataFrame:
    """B1 for evidence cases: (case_id, fingerprint).

    ``headers``: case_id, title.  ``sources``: case_id, pos, source_id, text.
    The digest covers case_id, title, the number of sources and the ordered
    (source_id, text) pairs.
    """
    leaves = sources.select("case_id", "pos", F.sha2(canon_record("source_id", "text"), 256).alias("leaf"))
    tree = ordered_digest(leaves, ["case_id"], "pos", "leaf", block, levels, out="tree")
    counts = sources.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_sources"))
    return (
        headers.select("case_id", "title")
        .join(counts, "case_id", "left")
        .join(tree, "case_id", "left")
        .select(
            "case_id",
            F.sha2(
                F.concat(canon_record("case_id", "title", F.coalesce("n_sources", F.lit(0))),
                         F.coalesce("tree", F.lit(NULL_TOKEN))),
                256,
            ).alias("fingerprint"),
        )
    )
