"""What must not stand in a physical plan: cartesian and nested-loop joins, row-at-a-time
Python UDFs, windows without a partition key (which run on one task)."""

from contextlib import contextmanager

from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter


def _nodes(plan):
    stack = [plan]
    while stack:
        p = stack.pop()
        yield p
        for i in range(p.children().size()):
            stack.append(p.children().apply(i))
        # subqueries and AQE wrappers
        for inner in ("executedPlan", "initialPlan"):
            try:
                stack.append(getattr(p, inner)())
            except Exception:
                pass


def findings(df) -> list[str]:
    out = []
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        cls = node.getClass().getSimpleName()
        if cls in ("CartesianProductExec", "BroadcastNestedLoopJoinExec", "BatchEvalPythonExec"):
            out.append(cls)
        if cls == "WindowExec" and node.partitionSpec().isEmpty():
            out.append("window without partition key")
    return out


@contextmanager
def eager_plans():
    """Findings in the plans that are checkpointed or written meanwhile."""
    found: list[str] = []
    checkpoint, writers = DataFrame.checkpoint, {k: getattr(DataFrameWriter, k) for k in ("parquet", "json", "csv", "text")}

    def checked(self, *a, **b):
        found.extend(findings(self))
        return checkpoint(self, *a, **b)

    def writing(write):
        def run(self, *a, **b):
            found.extend(findings(self._df))
            return write(self, *a, **b)
        return run

    DataFrame.checkpoint = checked
    for k, write in writers.items():
        setattr(DataFrameWriter, k, writing(write))
    try:
        yield found
    finally:
        DataFrame.checkpoint = checkpoint
        for k, write in writers.items():
            setattr(DataFrameWriter, k, write)
