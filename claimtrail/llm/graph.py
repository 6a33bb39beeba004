"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (its larger ones, or its smaller ones and itself)
    linked to the smallest of its neighbourhood.  The smallest comes from a
    partial aggregate; the join back splits a node with many links."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``: its component's
    smallest node.  Each round is written to a table in the shared folder; the
    driver sees only a count and a checksum of the links."""
    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .where("u <> v").distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        now = stored(_stars(_stars(now, large=True), large=False), "links")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
