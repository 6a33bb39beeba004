"""Scale lint over the training-data queries' plans, returned, checkpointed and written."""

import pytest

from claimtrail.llm import queries
from tests.plan_lint import eager_plans, findings


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if not q.startswith(("op2_", "op9_"))])
def test_no_unscalable_operators(spark, name):
    with eager_plans() as eager:
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert findings(df) == [] and eager == []


def test_mixing_runs_no_python(spark):
    """Its contract: DataFrame functions only."""
    df = queries.op5_mixing(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
