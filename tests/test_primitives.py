"""Edge cases of the distributed primitives and session helpers."""

from pyspark.sql import functions as F

from claimtrail.functions.rank import global_rank, global_running_sum, rank_within
from claimtrail.functions.scan import fsm_fold
from claimtrail.session import checkpoint_root, scratch_path


def test_checkpoint_and_scratch_folders(spark):
    root = checkpoint_root(spark)
    assert root and checkpoint_root(spark) == root            # read from the session, stable
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root.rstrip("/"))           # a new folder per use


def test_global_rank_empty_and_sparse(spark):
    empty = spark.createDataFrame([], "k long")
    r = global_rank(empty, ["k"])
    assert r.n == 0 and r.df.count() == 0
    few = spark.createDataFrame([(5,), (1,), (3,)], "k long")
    r = global_rank(few, ["k"], num_partitions=16)               # more partitions than rows
    assert [(x.k, x.rank) for x in r.df.orderBy("rank").collect()] == [(1, 1), (3, 2), (5, 3)]


def test_running_sum_and_rank_within(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"),
                                     F.lit(1.0).alias("v"))
    r = global_running_sum(df, ["k"], "v", num_partitions=9)
    got = {x.k: x.running_sum for x in r.df.collect()}
    assert all(got[k] == float(k) for k in range(1, 1001))
    ranked = global_rank(df, ["g", "k"], num_partitions=5).df
    rw = rank_within(ranked, ["g"], "rank", "rg", "size")
    rows = rw.where("g = 3").orderBy("k").collect()
    assert [x.rg for x in rows] == list(range(1, len(rows) + 1)) and rows[0].size == len(rows)


def test_fsm_fold_empty_input(spark):
    ev = spark.createDataFrame([], "case_id string, seq long, t int")
    assert fsm_fold(ev, "case_id", "seq", "t", [[False, True], [False, False]]).count() == 0
