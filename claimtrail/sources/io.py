"""Readers and writers.  Every reader takes an explicit schema (no
inference), so a directory of any size is read without a sampling pass."""

from __future__ import annotations

import os
from collections.abc import Sequence
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rank import global_rank, rank_within

# The field names of the files that are read and written.
SOURCE = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("text", T.StringType())])
CASE = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("sources", T.ArrayType(SOURCE)), T.StructField("expected_risk", T.StringType()),
])
SARIF_RESULT = T.StructType([
    T.StructField("ruleId", T.StringType()), T.StructField("level", T.StringType()),
    T.StructField("message", T.StructType([T.StructField("text", T.StringType())])),
    T.StructField("locations", T.ArrayType(T.StructType([T.StructField("physicalLocation", T.StructType([
        T.StructField("artifactLocation", T.StructType([T.StructField("uri", T.StringType())]))]))]))),
])
SARIF = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("runs", T.ArrayType(T.StructType([
        T.StructField("tool", T.StructType([T.StructField("driver", T.StructType([
            T.StructField("name", T.StringType())]))])),
        T.StructField("results", T.ArrayType(SARIF_RESULT)),
    ]))),
])
SCOPE = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("engagement_id", T.StringType()),
    T.StructField("customer", T.StringType()), T.StructField("expires_on", T.StringType()),
    T.StructField("egress", T.StringType()),
    T.StructField("repositories", T.ArrayType(T.StructType([
        T.StructField("repository_id", T.StringType()), T.StructField("path", T.StringType()),
        T.StructField("allowed_checks", T.ArrayType(T.StringType()))]))),
])
AUDIT = T.StructType([
    T.StructField("chain", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("ts_us", T.LongType()),
    T.StructField("event", T.StringType()), T.StructField("case_id", T.StringType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    T.StructField("previous_hash", T.StringType()), T.StructField("event_hash", T.StringType()),
])
PREDICTION = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("pred", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("probs", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("free_top_token", T.StringType()), T.StructField("free_top_is_letter", T.BooleanType()),
    T.StructField("correct", T.BooleanType()), T.StructField("image_tokens", T.LongType()),
])
MEASUREMENT = "image string, px1 string, px2 string, measured_mm double"
TRUTH = "object string, true_mm double"
MANIFEST = "path string, label string, split string, bytes long, sha256 string"
TRAIN_LOG = T.StructType([
    T.StructField("global_step", T.LongType()),
    T.StructField("log_history", T.ArrayType(T.StructType([
        T.StructField("epoch", T.DoubleType()), T.StructField("grad_norm", T.DoubleType()),
        T.StructField("learning_rate", T.DoubleType()), T.StructField("loss", T.DoubleType()),
        T.StructField("step", T.LongType())]))),
])

MAX_SARIF_BYTES = 50_000_000
SMALL_FILE = 1 << 20        # a text file up to this size is split into its lines as one value
BOM = b"\xef\xbb\xbf"
FOLDER_FILES = 500          # files of a folder, which is listed at once
COMPRESSED = r"\.(gz|bz2|deflate|lz4|lzo|snappy|xz|zst|zstd)$"     # their size says nothing of their text's
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png")


# ---------------------------------------------------------------- A1
def read_cases(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A1: case JSON lines (golden files add ``expected_risk``); blank lines
    are skipped by the JSON reader; ``multiline`` for one object per file."""
    return spark.read.schema(CASE).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)


def explode_cases(cases: DataFrame):
    """Nested cases → (headers(case_id, title), sources(case_id, pos,
    source_id, text)); ``pos`` is the 0-based tuple order."""
    headers = cases.select("case_id", "title")
    sources = cases.select("case_id", F.posexplode("sources").alias("pos", "s")).select(
        "case_id", F.col("pos").cast("bigint").alias("pos"), F.col("s.source_id").alias("source_id"),
        F.col("s.text").alias("text"))
    return headers, sources


# ---------------------------------------------------------------- A2
def read_sarif(spark: SparkSession, path: str, max_bytes: int = MAX_SARIF_BYTES, glob: str = "*.sarif"):
    """A2: SARIF files → (documents(doc_id = file path, sarif struct),
    rejected(path, length, reason)).  The size cap is a filter on the
    ``length`` column, which the binary file source evaluates before it reads
    a file's content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(path)
    ok = files.where(F.col("length") <= F.lit(max_bytes)).select(
        F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("_text"))
    parsed = F.from_json("_text", SARIF, {"allowSingleQuotes": "false"})
    # a document without runs is an empty report; runs that are no array are refused
    absent = F.get_json_object("_text", "$.runs").isNull() & F.regexp_like("_text", F.lit(r"^\s*\{"))
    ok = ok.select("doc_id", F.when(parsed["runs"].isNotNull(), parsed).when(parsed.isNotNull() & absent, parsed.withField(
        "runs", F.array().cast(SARIF["runs"].dataType))).alias("sarif"))
    rejected = files.where(F.col("length") > F.lit(max_bytes)).select(
        "path", "length", F.lit("SARIF report exceeds the configured size limit").alias("reason"))
    bad = ok.where(F.col("sarif").isNull()).select(
        F.col("doc_id").alias("path"), F.lit(None).cast("long").alias("length"),
        F.lit("SARIF report must contain a runs array").alias("reason"))
    return ok.where(F.col("sarif").isNotNull()), rejected.unionByName(bad)


# ---------------------------------------------------------------- A3
def read_scope(spark: SparkSession, path: str):
    """A3: scope manifests (one JSON object per file) → (scopes,
    scope_repos) in the long form of ``operators.scope``."""
    raw = spark.read.schema(SCOPE).option("multiLine", True).json(path)
    scopes = raw.select("engagement_id", F.col("version").cast("int").alias("version"), "egress", "customer",
                        F.to_date("expires_on").alias("expires_on"))
    repos = raw.select("engagement_id", F.posexplode_outer("repositories").alias("pos", "r")).where(
        F.col("r").isNotNull()).select(
        "engagement_id", F.col("pos").cast("bigint").alias("pos"), F.col("r.repository_id").alias("repository_id"),
        F.col("r.path").alias("path"), F.coalesce(F.col("r.allowed_checks"), F.array().cast("array<string>")).alias(
            "allowed_checks"))
    return scopes, repos


# ---------------------------------------------------------------- A4
def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their 1-based line number per file.  A file of at most ``SMALL_FILE`` bytes is split in its
    task, in one pass and without a shuffle, so many small files cost little more than being opened.  A larger (or
    compressed) file is never one value: its line order is (file, split start, position in the split), made dense
    by a global rank."""
    files = spark.read.format("binaryFile").load(path)      # one listing; opens a file without copying the configuration
    large = (F.col("_metadata.file_size") > F.lit(SMALL_FILE)) | F.col("_metadata.file_name").rlike(COMPRESSED)
    lines = _small_files(files.where(~large).coalesce(_tasks(spark)))       # the scan deals 32 files to a task
    if files.where(large).select(F.lit(1)).isEmpty():        # a condition on the listing, nothing is read
        return lines
    return lines.unionByName(_ranked_lines(spark.read.text(path).where(large)))


def _small_files(files: DataFrame) -> DataFrame:
    """Lines as the text reader finds them (ended by LF, CR or both; no byte order mark).  The bytes are split as
    Latin-1, one character each, so a line that is no valid UTF-8 stays as it is."""
    t = files.where((F.length("content") > 0) & (F.col("content") != F.lit(BOM))).select(
        F.col("_metadata.file_path").alias("file"), F.decode("content", "ISO-8859-1").alias("_text"))
    text = F.when(F.startswith("_text", F.lit(BOM.decode("latin-1"))), F.expr("substring(_text, 4)")).otherwise(F.col("_text"))
    t = t.select("file", F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")).alias("_text"))
    body = F.when(F.endswith("_text", F.lit("\n")), F.left("_text", F.length("_text") - 1)).otherwise(F.col("_text"))
    # the outer form: the array is never empty, and the optimizer adds no filter that splits a second time
    return t.select("file", F.posexplode_outer(F.split(body, "\n")).alias("_pos", "_line")).select(
        "file", F.encode("_line", "ISO-8859-1").cast("string").alias("line"),
        (F.col("_pos") + 1).cast("bigint").alias("line_no"))


def _ranked_lines(t: DataFrame) -> DataFrame:
    t = t.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"), F.col("value").alias("line"))
    r = global_rank(t, [F.col("file"), F.col("_blk"), F.col("_mid")], "_rk", table=True).df
    return rank_within(r, ["file"], "_rk", "line_no", None).drop("_blk", "_mid", "_rk")


def read_audit(spark: SparkSession, path: str, chain_type: str = "bigint") -> DataFrame:
    """A4: our audit JSONL (rows carry chain and seq); a malformed line
    yields a row of nulls, which chain verification counts as invalid."""
    schema = T.StructType([T.StructField("chain", T._parse_datatype_string(chain_type))] + AUDIT.fields[1:])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


# ---------------------------------------------------------------- A5
def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEASUREMENT).option("header", True).csv(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """A5: (object, true_mm, truth_pos), ``truth_pos`` counting the rows in file order."""
    rows = spark.read.schema(TRUTH).option("header", True).csv(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"))
    return global_rank(rows, ["_file", "_blk", "_mid"], "truth_pos", table=True).df.drop("_file", "_blk", "_mid")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", True).csv(path)


# ---------------------------------------------------------------- A6
def file_manifest(spark: SparkSession, root: str, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """Path relative to ``root``, label (= parent folder), bytes and
    SHA-256 of every file whose extension matches (case-insensitive); other files are not listed."""
    any_case = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip("."))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.{" + ",".join(map(any_case, extensions)) + "}").load(root))
    top = root.rstrip("/") + "/"
    rel = F.expr("substring(path, instr(path, top) + length(top))")
    return files.withColumn("top", F.lit(top)).select(
        rel.alias("path"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"),
        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


# ---------------------------------------------------------------- A7
def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    """Trainer state JSON → one row per logged step (``run`` = file)."""
    raw = spark.read.schema(TRAIN_LOG).option("multiLine", True).json(path) \
        .withColumn("run", F.col("_metadata.file_path"))
    return raw.select("run", F.explode("log_history").alias("h")).select(
        "run", F.col("h.step").alias("step"), F.col("h.loss").alias("loss"), F.col("h.epoch").alias("epoch"),
        F.col("h.learning_rate").alias("learning_rate"), F.col("h.grad_norm").alias("grad_norm"))


def read_text_log(spark: SparkSession, path: str, pattern: str = r"'loss': ([0-9.eE+-]+)") -> DataFrame:
    """A7 (text logs): lines that carry a loss value."""
    t = read_lines(spark, path)
    v = F.regexp_extract("line", pattern, 1)
    return t.where(v != "").select("file", "line_no", v.cast("double").alias("loss"))


# ---------------------------------------------------------------- A8
def write_audit(audit: DataFrame, path: str) -> None:
    """Append audit rows as JSON lines (one folder, appended files)."""
    audit.write.mode("append").json(path)


def write_report(reports: DataFrame, path: str, key: str = "repository_id", text: str = "text") -> None:
    """One text artifact per repository, written as partitioned text."""
    spread(reports.select(key, text), key).write.mode("overwrite").partitionBy(key).text(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to a fixed number of tasks, before a folder for each key is written.  A file costs the same
    however small it is, but by their bytes alone small files would all be merged into one task."""
    return rows.repartition(_tasks(rows.sparkSession), key)


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def write_text_files(rows: DataFrame, path: str, key: str, text: str) -> None:
    """One text file for each value of ``key``, its lines in the order of ``rows`` (null is a blank line).  ``rows`` must hold a
    key in one task (``spread``).  A file of key 5 is ``part=<n>/<key>=5.txt``.  In a local or mounted folder Hadoop's classes
    start five processes for each file (chmod), so there the tasks write by themselves, each attempt into folders of its own;
    those of the attempts that count are renamed when all have ended.  Other stores take Spark's writer, whose
    file is ``<key>=5/part-...txt``."""
    spark = rows.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = jvm_path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        rows.select(key, text).write.partitionBy(key).text(path)
        return
    fs.mkdirs(at)                                   # also when there are no rows
    folder = fs.makeQualified(at).toUri().getPath()
    written = rows.select(F.col(key).cast("string"), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n"))).mapInArrow(
        _file_writer(folder, key, FOLDER_FILES), "folder string").collect()       # a name for FOLDER_FILES files
    for n, r in enumerate(written):
        if not fs.rename(jvm_path(f"{folder}/{r.folder}"), jvm_path(f"{folder}/part={n}")):
            raise OSError(f"{folder}/{r.folder} was not renamed")


def _file_writer(folder: str, key: str, most: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        task = TaskContext.get()
        own = f"_attempt-{task.partitionId()}-{task.taskAttemptId()}"
        names, name, out = {}, None, None           # file -> its number
        try:
            for batch in batches:
                lines = batch.column(1).cast(pa.large_binary())
                starts = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + len(lines) + 1]
                data, first = memoryview(lines.buffers()[2] or b""), 0
                runs = pc.run_end_encode(batch.column(0))
                for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    now = f"{key}={'__HIVE_DEFAULT_PARTITION__' if value is None else quote(value, safe='')}.txt"
                    if now != name:
                        if out:
                            out.close()
                        n = names.setdefault(now, len(names)) // most
                        os.makedirs(f"{folder}/{own}-{n}", exist_ok=True)
                        name, out = now, open(f"{folder}/{own}-{n}/{now}", "ab")
                    out.write(data[starts[first]:starts[end]])
                    first = end
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_pydict({"folder": pa.array([f"{own}-{n}" for n in range(-(-len(names) // most))], pa.string())})
    return run
