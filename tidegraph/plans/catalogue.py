"""All queries and their SQL by name."""

from tidegraph.plans import more  # noqa: F401  its queries join the registry
from tidegraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
