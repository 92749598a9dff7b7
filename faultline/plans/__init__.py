"""Queries over the test tables."""

from faultline.plans import (  # noqa: F401
    queries_decisions,
    queries_extraction,
    queries_flows,
    queries_mining,
    queries_retrieval,
    queries_tickets,
)
from faultline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
