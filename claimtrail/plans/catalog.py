"""The registered queries: one or more per operator of SURVEY §2, each a
callable ``(spark, sf_dir) -> DataFrame`` over a fixture view of the driver's
tables, and the matching DuckDB statement where SQL can express it.  The
queries live in ``plans/queries/`` (one module per operator group)."""

from .queries import ORACLES, QUERIES, register  # noqa: F401
from .queries._shared import flagship  # noqa: F401
