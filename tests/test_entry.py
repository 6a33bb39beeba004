"""The driver contract: entry, queries, oracle_sql — and every registered
query against its DuckDB statement on the smallest tables."""

import json
import os

import pytest

import __spark_entry__ as E
from claimtrail.plans import catalog
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["case_id", "risk", "quote", "reason", "state"]
    assert df.count() > 0


def test_oracle_keys_are_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 90


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_all_queries_match_oracle(spark):
    qs, sqls = E.queries(), E.oracle_sql()
    bad = []
    for name in catalog.QUERIES:        # the training-data queries have their own tests
        fn = qs[name]
        r = compare(spark, name, fn, sqls.get(name), SF)
        if r["status"] not in ("ok", "rows-only"):
            bad.append(json.dumps(r, default=str)[:600])
    assert not bad, "\n".join(bad)
