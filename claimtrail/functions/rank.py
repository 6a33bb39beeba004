"""Global rank over a total order without a single-partition window.

An un-partitioned ``row_number()`` window moves every row to one task.
Instead: range-partition on the order keys, sort inside each partition, tag
rows with ``monotonically_increasing_id`` (partition id in the high bits,
position in the low 33 bits), materialize with a reliable checkpoint or a table
on disk (range
bounds are sampled, so both passes must see the same layout), count rows per
partition, and add each partition's prefix offset.  The per-partition counts
are the only rows the driver sees (one per partition).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root, written

_LOW_BITS = 33


@dataclass
class Ranked:
    df: DataFrame        # input columns + rank column (1-based, bigint)
    n: int               # total number of rows


def _sort_cols(order_by: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def global_rank(df: DataFrame, order_by: Sequence, rank_col: str = "rank",
                num_partitions: int | None = None, keep_partition: str | None = None, table: bool = False) -> Ranked:
    """``order_by`` must be a total order (end it with a unique key).
    ``keep_partition`` names a column for the number of a row's range.  ``table`` writes the
    ranges as a table, a third of a checkpoint's size, which does not keep the order of the rows."""
    spark = df.sparkSession
    checkpoint_root(spark)
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _sort_cols(order_by)
    laid_out = (
        df.repartitionByRange(n_parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    laid_out = written(laid_out, "ranked") if table else laid_out.checkpoint(eager=True)
    counts = {
        r["pid"]: r["n"]
        for r in laid_out.groupBy((F.shiftright(F.col("_mid"), _LOW_BITS)).alias("pid"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    top = max(counts) if counts else -1
    offsets, acc = [], 0
    for pid in range(top + 1):
        offsets.append(acc)
        acc += counts.get(pid, 0)
    place = F.shiftright(F.col("_mid"), _LOW_BITS).cast("int")
    # the offsets as a small table: one row for each range
    starts = spark.createDataFrame(list(enumerate(offsets)), "_pid int, _offset bigint")
    laid_out = laid_out.withColumn("_pid", place).join(F.broadcast(starts), "_pid")
    offset = F.col("_offset")
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    ranked = laid_out.withColumn(rank_col, (offset + local + 1).cast("bigint")).drop("_mid", "_offset")
    ranked = ranked.withColumnRenamed("_pid", keep_partition) if keep_partition else ranked.drop("_pid")
    return Ranked(ranked, acc)


def global_running_sum(df: DataFrame, order_by: Sequence, value: str, rank_col: str = "rank",
                       out: str = "running_sum", num_partitions: int | None = None) -> Ranked:
    """Rank plus the running sum of ``value`` over a total order, without a
    single-partition window: per-partition sums (one row per partition) give
    the offsets, and each partition adds its local cumulative sum in one
    streaming pass (Arrow batches, vectorized cumsum)."""
    import pandas as pd
    from pyspark.sql import types as T

    ranked = global_rank(df, order_by, rank_col, num_partitions, keep_partition="_range")
    laid = ranked.df
    sums = {r["_range"]: (r["s"] or 0) for r in laid.groupBy("_range").agg(F.sum(value).alias("s")).collect()}
    offsets, acc = {}, 0
    for pid in sorted(sums):
        offsets[pid] = acc
        acc += sums[pid]
    schema = T.StructType([f for f in laid.schema.fields if f.name != "_range"] + [T.StructField(out, T.DoubleType())])

    def run(it):
        cur, carry = None, 0.0
        for pdf in it:
            # a task may hold several ranges, one after the other, if the plan above coalesces
            for pid, part in pdf.groupby((pdf["_range"] != pdf["_range"].shift()).cumsum(), sort=False):
                now = int(part["_range"].iloc[0])
                if now != cur:
                    cur, carry = now, float(offsets.get(now, 0))
                sums_here = part[value].fillna(0).astype("float64").cumsum() + carry
                carry = float(sums_here.iloc[-1])
                yield part.drop(columns="_range").assign(**{out: sums_here})

    return Ranked(laid.mapInPandas(run, schema), ranked.n)


def rank_within(ranked: DataFrame, group_cols: Sequence[str], rank_col: str = "rank",
                out: str = "rank_in_group", size_col: str | None = "group_size") -> DataFrame:
    """Per-group rank from a global rank whose order starts with ``group_cols``:
    rank minus the group's first rank, plus one.  The group table is an
    aggregate (one row per group), written first: where its size allows the optimizer to broadcast it, the rows are not shuffled."""
    firsts = written(ranked.groupBy(*group_cols).agg(
        F.min(rank_col).alias("_first"), F.count(F.lit(1)).alias("_size")), "firsts")
    out_df = ranked.join(firsts, list(group_cols)).withColumn(
        out, (F.col(rank_col) - F.col("_first") + 1).cast("bigint"))
    if size_col:
        out_df = out_df.withColumn(size_col, F.col("_size").cast("bigint"))
    return out_df.drop("_first", "_size")
