"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, scratch_path

#: Stands in for a null document id inside joins; nulls therefore sort first.
NULL_ID = -(1 << 63)

#: Rows of one Arrow batch, at most: texts of a few kB each then take little of a
#: Python worker's memory, and of the queue that feeds it.
ROWS = 2048


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ``ROWS`` if it is larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, str(ROWS))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just ``_id`` (see ``key_id``) and ``text`` (null: empty), so that extra
    columns, whatever their names, never meet an operator's own."""
    bounded_batches(df.sparkSession)
    return df.select(key_id(F.col(id_col).cast("long")).alias("_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def key_id(c: str | Column) -> Column:
    """A null id as the reserved smallest number: Python tasks and joins then
    see plain integers, and large ids never pass through floats."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(NULL_ID).cast("long"))


def real_id(c: str | Column = "_id") -> Column:
    """The inverse of ``key_id``."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(NULL_ID).cast("long"))


def slices(batches: Iterator[pd.DataFrame], max_bytes: int = 4 << 20, text: str = "text") -> Iterator[pd.DataFrame]:
    """The same rows in pieces of about ``max_bytes`` of text (one row at least)."""
    for pdf in batches:
        if not len(pdf):
            continue
        size = pdf[text].str.len().cumsum().to_numpy()
        lo = 0
        while lo < len(pdf):
            done = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(size.searchsorted(done + max_bytes, side="right")))
            yield pdf.iloc[lo:hi]
            lo = hi


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to a new table in the shared scratch folder and read back, which
    cuts the lineage and lets Spark see the table's true size."""
    spark: SparkSession = df.sparkSession
    checkpoint_root(spark)
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:6]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
