"""The registered queries, one module per operator group of SURVEY §2; importing
this package fills ``QUERIES`` and ``ORACLES``."""

from . import (chain, classification, evaluation, evidence, measurement, reporting,  # noqa: F401
               scope, sources, streaming, validation, workflow)
from ._shared import ORACLES, QUERIES, register  # noqa: F401
