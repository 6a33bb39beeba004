"""Scale lint over every registered query's physical plans: the one it returns, and those that it
checkpoints or writes on the way."""

import os

import pytest

from claimtrail.plans import catalog
from tests.plan_lint import eager_plans, findings

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_no_unscalable_operators(spark):
    bad = []
    for name, fn in catalog.QUERIES.items():
        with eager_plans() as eager:
            df = fn(spark, SF)
        bad += [f"{name}: {x}" for x in findings(df)] + [f"{name}, on the way: {x}" for x in eager]
    assert not bad, bad


def test_the_lint_sees_written_plans(spark, tmp_path):
    a = spark.range(5)
    with eager_plans() as eager:
        a.crossJoin(a.withColumnRenamed("id", "b")).write.parquet(str(tmp_path / "x"))
        a.selectExpr("row_number() over (order by id) as n").checkpoint()
    assert any("Product" in x or "NestedLoop" in x for x in eager) and "window without partition key" in eager
