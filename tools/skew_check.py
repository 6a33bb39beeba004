"""Skew check: run operators on a table in which one key holds a third of
all rows and report, from Spark's event log, the largest share of a stage's
records that a single task processed.

The skewed table is derived from the driver's ``events`` table: every third
event is re-assigned to user 0.  The event log goes to a new scratch folder
(no UI, no server).  Usage: python tools/skew_check.py [sf_dir] [cores]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def session(cores: str, log_dir: str) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName("skew-check")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
            .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
            .config("spark.sql.shuffle.partitions", "16").config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
            .config("spark.sql.files.maxPartitionBytes", str(256 * 1024))
            .config("spark.sql.session.timeZone", "UTC").getOrCreate())


def stage_shares(log_dir: str, job_group: str) -> tuple[float, int, int]:
    """(largest single-task share of the rows a shuffle stage reads, over
    stages with at least 4 tasks; largest number of shuffled rows one task
    read; rows all shuffle reads of the group's jobs fetched)."""
    per_stage = defaultdict(list)
    shuffle_task_max, shuffle_total = 0, 0
    stages_of_group = set()
    for path in glob.glob(f"{log_dir}/**", recursive=True):
        if os.path.isdir(path) or "appstatus" in os.path.basename(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    props = ev.get("Properties") or {}
                    if props.get("spark.jobGroup.id") == job_group:
                        stages_of_group.update(ev.get("Stage IDs", []))
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    shuf = m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
                    recs = m.get("Input Metrics", {}).get("Records Read", 0) + shuf
                    per_stage[ev["Stage ID"]].append((recs, shuf))
    worst = 0.0
    for sid in stages_of_group:
        recs = [sh for _, sh in per_stage.get(sid, [])]     # shuffle reads: where a hot key would land
        total = sum(recs)
        if len(recs) >= 4 and total >= 1000:      # skip the tiny per-partition count stages
            worst = max(worst, max(recs) / total)
        for _, sh in per_stage.get(sid, []):
            shuffle_task_max = max(shuffle_task_max, sh)
            shuffle_total += sh
    return worst, shuffle_task_max, shuffle_total


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cores = sys.argv[2] if len(sys.argv) > 2 else "8"
    log_dir = tempfile.mkdtemp(prefix="skew-eventlog-")
    spark = session(cores, log_dir)
    from claimtrail.functions.rank import global_rank
    from claimtrail.operators import chain, evaluate, evidence, triage, validate, workflow
    from claimtrail.session import prepare
    prepare(spark)
    sc = spark.sparkContext

    ev = spark.read.parquet(f"{sf}/events.parquet")
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id"))
    skewed = ev.withColumn("user_id", hot)
    case = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    sources = skewed.select(case.alias("case_id"), F.col("event_id").alias("pos"),
                            F.col("event_id").cast("string").alias("source_id"), F.col("props").alias("text"))
    headers = sources.select("case_id").distinct().withColumn("title", F.lit("t"))
    states = {"signup": "received", "view": "pending_approval", "click": "approved", "purchase": "published",
              "error": "failed"}
    to_state = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])[F.col("event_type")]
    transitions = skewed.select(case.alias("case_id"), F.col("event_id").alias("seq"), to_state.alias("to_state"))
    audit = skewed.select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"),
                          F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
                          F.col("event_type").alias("event"), case.alias("case_id"),
                          F.create_map(F.lit("props"), F.col("props")).alias("details"))
    obs = skewed.select(F.lit("e").alias("engagement_id"), case.alias("repository_id"), F.col("event_id").alias("pos"),
                        F.col("event_id").cast("string").alias("observation_id"), F.col("event_type").alias("check"),
                        F.lit("review").alias("status"), F.lit("low").alias("severity"), F.lit("p").alias("path"),
                        F.col("props").alias("message"))
    appended = chain.chain_append(audit).checkpoint(eager=True)

    checks = {
        "E1 validate_cases (partial aggregates)": lambda: validate.validate_cases(headers, sources),
        "F1 keyword_classify (partial aggregates)": lambda: triage.keyword_classify(headers, sources),
        "F2 triage (top-10 group limit)": lambda: triage.triage(headers, sources),
        "D7 select_evidence (group limit before shuffle)": lambda: evidence.select_evidence(obs),
        "B1 case_fingerprints (Merkle blocks)": lambda: __import__(
            "claimtrail.functions.hashing", fromlist=["x"]).case_fingerprints(headers, sources),
        "G4 fold_states (segmented fold)": lambda: workflow.fold_states(transitions),
        "B4 chain_verify (rank equi-join)": lambda: chain.chain_verify(appended),
        "H13 stratified_split (global rank)": lambda: evaluate.stratified_split(
            skewed.select("event_id", "user_id"), "user_id", "event_id"),
        "global_rank": lambda: global_rank(skewed.select("user_id", "event_id"), ["user_id", "event_id"]).df,
        "B3 chain_append (serial per chain, by definition)": lambda: chain.chain_append(audit),
    }
    rows = []
    for i, (name, build) in enumerate(checks.items()):
        group = f"skew-{i}"
        sc.setJobGroup(group, name)
        build().write.format("noop").mode("overwrite").save()
        rows.append((name, group))
    sc.setJobGroup("done", "done")
    spark.stop()
    print("hot key: user 0 holds 1/3 of all rows.  share = largest single-task share of the rows a")
    print("shuffle stage reads (16 partitions, no coalescing: 6.3 % is an even split);")
    print("max shuffled rows/task = most shuffled rows one task read")
    print(f"  {'share':>6}  {'max shuffled rows/task':>22}  {'shuffled rows':>13}  operator")
    for name, group in rows:
        share, task_max, shuffled = stage_shares(log_dir, group)
        print(f"  {share:6.1%}  {task_max:22d}  {shuffled:13d}  {name}")


if __name__ == "__main__":
    main()
