"""Fingerprints and the hash-chained audit trail."""

import hashlib
import json

from pyspark.sql import functions as F

from claimtrail.functions.hashing import case_fingerprints, fingerprint
from claimtrail.operators import chain
from claimtrail.sources import io as sio


def audit_rows(spark, n=20, chains=("c1",)):
    rows = [(c, i, 1_700_000_000_000_000 + i, f"ev{i % 3}", f"case-{c}", {"k": str(i)})
            for c in chains for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "chain string, seq long, ts_us long, event string, case_id string, "
                                       "details map<string,string>")


def test_append_verify_tamper(spark):
    a = chain.chain_append(audit_rows(spark, 20, ("c1", "c2"))).cache()
    v = {r.chain: r for r in chain.chain_verify(a).collect()}
    assert v["c1"].valid and v["c2"].valid and v["c1"].n == 20
    edited = a.withColumn("event", F.when((F.col("chain") == "c1") & (F.col("seq") == 7), F.lit("x")).otherwise(F.col("event")))
    v2 = {r.chain: r for r in chain.chain_verify(edited).collect()}
    assert not v2["c1"].valid and v2["c1"].first_bad_seq == 7 and v2["c2"].valid
    dropped = a.where(~((F.col("chain") == "c2") & (F.col("seq") == 5)))
    v3 = {r.chain: r for r in chain.chain_verify(dropped).collect()}
    assert not v3["c2"].valid and v3["c2"].first_bad_seq == 6


def test_resume_from_tail_equals_one_pass(spark):
    full = chain.chain_append(audit_rows(spark, 20))
    first = chain.chain_append(audit_rows(spark, 20).where("seq <= 8"))
    second = chain.chain_append(audit_rows(spark, 20).where("seq > 8"), tails=chain.chain_tail(first))
    both = {(r.seq, r.event_hash) for r in first.unionByName(second).collect()}
    assert both == {(r.seq, r.event_hash) for r in full.collect()}


def test_hot_chain_verified_across_partitions(spark):
    a = chain.chain_append(audit_rows(spark, 3000, ("hot",)))
    assert chain.chain_verify(a, num_partitions=16).first().valid


def test_malformed_audit_line_is_invalid(spark, tmp_path):
    a = chain.chain_append(audit_rows(spark, 5))
    p = str(tmp_path / "audit")
    sio.write_audit(a, p)
    with open(tmp_path / "audit" / "zz-broken.json", "w") as fh:
        fh.write('{"chain": "c1", "seq": 6, "event": \n')
    back = sio.read_audit(spark, p, chain_type="string")
    back = back.withColumn("chain", F.coalesce("chain", F.lit("c1")))
    v = chain.chain_verify(back).collect()
    assert len(v) == 1 and not v[0].valid


def test_foreign_jsonl_chain(spark, tmp_path):
    """A file in the single-chain JSON-lines format (written here by a plain
    Python model of it) verifies; an edited line does not."""
    prev, lines = "0" * 64, []
    for i in range(20):
        rec = {"timestamp": f"2026-01-01T00:00:{i:02d}+00:00", "event": "e", "case_id": "c", "details": {"n": i},
               "previous_hash": prev}
        h = hashlib.sha256(json.dumps(rec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        rec["event_hash"] = h
        lines.append(json.dumps(rec, sort_keys=True))
        prev = h
    good = tmp_path / "good.jsonl"
    good.write_text("\n".join(lines) + "\n")
    bad = tmp_path / "bad.jsonl"
    bad.write_text("\n".join(lines[:9] + [lines[9].replace('"event": "e"', '"event": "x"')] + lines[10:]) + "\n")
    res = {r.file.rsplit("/", 1)[-1]: r for r in chain.foreign_chain_verify(sio.read_lines(spark, str(tmp_path))).collect()}
    assert res["good.jsonl"].valid and res["good.jsonl"].n == 20
    assert not res["bad.jsonl"].valid and res["bad.jsonl"].first_bad_line == 10


def test_fingerprints(spark):
    h = spark.createDataFrame([("a", "t"), ("b", "t")], "case_id string, title string")
    s = spark.createDataFrame([("a", 0, "x", "1"), ("a", 1, "y", "2"), ("b", 0, "y", "2"), ("b", 1, "x", "1")],
                              "case_id string, pos long, source_id string, text string")
    fp = {r.case_id: r.fingerprint for r in case_fingerprints(h, s).collect()}
    assert fp["a"] != fp["b"]          # order matters
    one = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    assert len({r.f for r in one.select(fingerprint("x", "y").alias("f")).collect()}) == 2
    # the canonical JSON helper matches Python's json.dumps
    j = spark.createDataFrame([('{"b": 1, "a": [1, 2], "é": "x"}',)], "j string")
    assert j.select(chain.canonical_json("j").alias("c")).first().c == json.dumps(
        {"b": 1, "a": [1, 2], "é": "x"}, sort_keys=True, separators=(",", ":"))
