"""All panel queries and their oracle SQL, by name."""

from gridloom.plans import eda_queries, io_queries, ml_queries, panel_queries, spatial_queries, workflow_queries  # noqa: F401
from gridloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
