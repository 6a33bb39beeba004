"""The corpus pipeline: quality, exact copies, near copies, source mix, token ids.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept
and returns a DataFrame; all but the last return the columns of ``documents``.  An
empty table gives no rows in every stage; extra columns, whatever their names, are
dropped; a null text counts as empty; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimtrail.llm import exact, mixing, quality, queries, simhash
from claimtrail.llm._common import stored
from claimtrail.plans.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the two views on labelled rows of what is there; rejected documents go.

    Null source, language and size are values of their own; rows with a null id are scored like
    others and never labelled; repeated rows stay or go together, as equal rows have equal scores;
    a score equal to the threshold stays.  Without rows of both labels all documents stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model).select(COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays.

    A null id is smaller than all others; of rows that share text and largest id (repeated rows, ties)
    exactly one stays."""
    return exact.deduplicated(docs, keep="largest").select(COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of fingerprints linked at two or fewer bits one document stays, the smallest id.

    A null id is smaller than all others; of rows that share that id exactly one stays.  Empty texts
    have fingerprint zero and are linked like any other."""
    return simhash.deduplicated(docs).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times).

    A null source is a source of its own; texts without words add none, however often they are taken; ties
    and repeated rows are drawn by a hash of the row's id and text, so reruns agree."""
    return mixing.mixed(docs).select(COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to.

    One row for each row of the mix, copies and null ids included; empty texts have no tokens."""
    return queries.encoded(docs)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("SimHash near-dedup", simhash_stage),
          ("mixing sources", mixing_stage), ("byte-level BPE", bpe_stage)]

#: Classifier, fingerprints and token ids have no SQL form; see tests/llm for the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
