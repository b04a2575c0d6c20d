"""The catalogue of registered queries: QUERIES by name, and ORACLES, the SQL that most of them have."""

from areasignal.plans import areas, evidence, inputs, reports, scores  # noqa: F401  they register their queries
from areasignal.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
