"""All named queries of the engine."""

from evimatch.plans import files, matching, records, review  # noqa: F401
from evimatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
