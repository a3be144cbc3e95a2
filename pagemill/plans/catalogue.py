"""Importing this module registers every query."""

from pagemill.plans import q_elements, q_flows, q_joins, q_pages, q_sources, q_text, q_windows  # noqa: F401
from pagemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
