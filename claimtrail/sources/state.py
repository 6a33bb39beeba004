"""The workflow state table and the approved-export table.

No table format with MERGE is available here, so the state is versioned:
every upsert writes a complete new version ``<root>/v=<N>`` and then adds the
marker ``<root>/_CURRENT/<N>``.  Readers pin a version; a plan never overwrites
the folder it reads.  A crashed writer leaves a version folder without a
marker, and the previous version stays current.

With several writers the state is kept as commits instead: each adds a folder
with the changed cases only and names the version it was judged against; of two
writers on one version the second is refused.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import numbered_entries

STATE_COLUMNS = ("case_id", "case_fingerprint", "state", "risk", "assessment_fp", "reviewer", "receipt",
                 "updated_seq")


# Fixed value: the message of a refused update.
MSG_CONFLICT = "case_id already exists with a different evidence fingerprint"


# ---------------------------------------------------------------- A9
def judged_updates(state: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A9's rule: an update whose case is stored with another fingerprint is refused;
    of a new case's updates the first (lowest ``updated_seq``) sets the
    fingerprint and those with another one are refused.  Returns (the latest valid update of each case, refused updates)."""
    stored = state.select("case_id", F.col("case_fingerprint").alias("_stored"))
    first = updates.groupBy("case_id").agg(F.min_by("case_fingerprint", F.struct("updated_seq", "case_fingerprint")).alias("_first"))
    owner = first.join(stored, "case_id", "left").select("case_id", F.coalesce("_stored", "_first").alias("_owner"))
    judged = updates.join(owner, "case_id").withColumn("_ok", F.col("case_fingerprint").eqNullSafe(F.col("_owner")))
    latest = judged.where("_ok").groupBy("case_id").agg(
        F.max_by(F.struct(*[c for c in updates.columns if c != "case_id"]), "updated_seq").alias("_u")).select("case_id", "_u.*")
    refused = judged.where(~F.col("_ok")).select(
        "case_id", F.col("case_fingerprint").alias("attempted_fingerprint"), F.col("_owner").alias("stored_fingerprint"),
        F.lit(MSG_CONFLICT).alias("reason"))
    return latest, refused


def upsert_state(state: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state after ``judged_updates``, and the refused ones: (new state, refused updates)."""
    latest, refused = judged_updates(state, updates)
    old = state.select(*[F.col(c).alias(f"_o_{c}") if c != "case_id" else F.col(c) for c in state.columns])
    j = old.join(latest, "case_id", "full_outer")
    cols = [c for c in state.columns if c != "case_id"]
    new_state = j.select("case_id", *[F.when(F.col("updated_seq").isNotNull(), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c)
                                      for c in cols])
    return new_state, refused


def _pointers(root: str) -> str:
    return f"{root.rstrip('/')}/_CURRENT"


def current_version(spark: SparkSession, root: str) -> int | None:
    """The largest committed version; a marker is only ever added, so there is
    no moment without one."""
    return max(numbered_entries(spark, _pointers(root)), default=None)


def read_state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    v = current_version(spark, root) if version is None else version
    if v is None:
        return None
    return spark.read.parquet(f"{root.rstrip('/')}/v={v}")


def write_state(spark: SparkSession, df: DataFrame, root: str) -> int:
    """Write ``df`` as the next version, then add its marker.  A version folder
    that a crashed writer left has no marker; its number is not used again."""
    v = max([0, *numbered_entries(spark, root, "v="), *numbered_entries(spark, _pointers(root))]) + 1
    df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/v={v}")
    spark.createDataFrame([(str(v),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{_pointers(root)}/{v}")
    return v


# -- commits ---------------------------------------------------------------
class StateConflict(RuntimeError):
    """Another writer has committed on the expected version."""


def _commits(root: str) -> str:
    return f"{root.rstrip('/')}/_COMMITS"


def committed_version(spark: SparkSession, root: str) -> int:
    """The last commit's number, 0 before the first."""
    return max(numbered_entries(spark, _commits(root)), default=0)


def _folders(spark: SparkSession, root: str, version: int) -> list[str]:
    """The data folders that make up a version, oldest first."""
    if not version:
        return []
    return [r["value"] for r in spark.read.text(f"{_commits(root)}/{version}").collect()]


def _publish(spark: SparkSession, root: str, version: int, folders: list[str]) -> None:
    """Creates the commit's file, which fails if it is there: of several writers on one version one wins.
    (The file system must create without overwriting in one step, as HDFS does.)"""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{_commits(root)}/{version}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(path, False)
    except Exception as error:
        if fs.exists(path):
            raise StateConflict(f"version {version} is committed already") from error
        raise
    out.write(bytearray("\n".join(folders).encode()))
    out.close()


def read_commits(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """A committed version (default: the last): of each case the row of the newest folder that has one."""
    folders = _folders(spark, root, committed_version(spark, root) if version is None else version)
    if not folders:
        return None
    parts = [spark.read.parquet(f"{root.rstrip('/')}/{f}").withColumn("_n", F.lit(i)) for i, f in enumerate(folders)]
    if len(parts) == 1:
        return parts[0].drop("_n")
    whole = reduce(DataFrame.unionByName, parts)
    cols = [c for c in whole.columns if c not in ("case_id", "_n")]
    return whole.groupBy("case_id").agg(F.max_by(F.struct(*cols), "_n").alias("_r")).select("case_id", "_r.*")


def commit_updates(spark: SparkSession, root: str, updates: DataFrame, expected: int) -> tuple[int, DataFrame]:
    """A9 with several writers: (new version, refused updates).  Only the cases that change are written, to a folder of
    their own; no file of an earlier version is touched.  The commit names the folders of ``expected``
    and the new one; if another writer has committed on ``expected`` meanwhile it raises ``StateConflict``, and
    the caller reads the newer version and judges again.  ``compact`` puts the folders together from time to time."""
    if committed_version(spark, root) != expected:
        raise StateConflict(f"expected version {expected}, found {committed_version(spark, root)}")
    state = read_commits(spark, root, expected)
    latest, refused = judged_updates(updates.limit(0) if state is None else state, updates)
    folder = f"data/{uuid.uuid4().hex}"
    latest.write.parquet(f"{root.rstrip('/')}/{folder}")
    _publish(spark, root, expected + 1, [*_folders(spark, root, expected), folder])
    return expected + 1, refused


def compact(spark: SparkSession, root: str, expected: int) -> int:
    """The rows of ``expected`` in one new folder, as the next version; older versions stay readable."""
    folder = f"data/{uuid.uuid4().hex}"
    read_commits(spark, root, expected).write.parquet(f"{root.rstrip('/')}/{folder}")
    _publish(spark, root, expected + 1, [folder])
    return expected + 1


# ---------------------------------------------------------------- A10
def export_approved(approved: DataFrame, exported: DataFrame, destination: str = "handoff") -> DataFrame:
    """A10: approved(case_id, idempotency_key[, reviewer]) against already
    exported (slug, idempotency_key).  slug = first 20 hex of SHA-256(case_id).
    A blank reviewer → ``refused``; the same key → ``existing`` with the same
    receipt; another key under the slug → ``conflict``; none → ``export``."""
    slug = F.substring(F.sha2(F.col("case_id"), 256), 1, 20)
    named = ~is_blank("reviewer") if "reviewer" in approved.columns else F.lit(True)
    a = approved.select("case_id", "idempotency_key", slug.alias("slug"), named.alias("_named"))
    e = exported.select("slug", F.col("idempotency_key").alias("_ek"))
    j = a.join(e, "slug", "left")
    status = (F.when(~F.col("_named"), F.lit("refused"))
              .when(F.col("_ek").isNull(), F.lit("export"))
              .when(F.col("_ek") == F.col("idempotency_key"), F.lit("existing"))
              .otherwise(F.lit("conflict")))
    receipt = F.when(status.isin("export", "existing"), F.concat(F.lit(f"file:{destination}/approved-"), F.col("slug"),
                                                                 F.lit(".json")))
    return j.select("case_id", "slug", "idempotency_key", status.alias("status"), receipt.alias("receipt"))


def export_payloads(decided: DataFrame, details: DataFrame) -> DataFrame:
    """(slug, idempotency_key, payload) of the cases to export: the JSON of the
    case's details (one row for a case) with its key."""
    j = decided.where(F.col("status") == "export").join(details, "case_id")
    fields = [F.col("case_id"), F.col("idempotency_key"), *(F.col(c) for c in details.columns if c != "case_id")]
    return j.select("slug", "idempotency_key", F.to_json(F.struct(*fields)).alias("payload"))


EXPORT = "slug string, idempotency_key string, payload string"


def write_exports(spark: SparkSession, payloads: DataFrame, root: str) -> int:
    """Appends one batch of exports as a new numbered folder."""
    n = max(numbered_entries(spark, root, "batch="), default=0) + 1
    payloads.select("slug", "idempotency_key", "payload").write.mode("errorifexists").parquet(f"{root.rstrip('/')}/batch={n}")
    return n


def read_exports(spark: SparkSession, root: str) -> DataFrame:
    batches = numbered_entries(spark, root, "batch=")
    if not batches:
        return spark.createDataFrame([], EXPORT)
    return spark.read.schema(EXPORT).parquet(*(f"{root.rstrip('/')}/batch={n}" for n in batches))
