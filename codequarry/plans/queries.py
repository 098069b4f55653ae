"""All named queries and their SQL."""

from codequarry.plans import catalog, kept_queries  # noqa: F401  each registers its own
from codequarry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
