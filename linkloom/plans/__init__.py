"""Registered queries and their oracle SQL."""

from linkloom.plans import compounds, derived, edits, graph, links, more, records  # noqa: F401
from linkloom.plans.registry import ORACLES, QUERIES  # noqa: F401
