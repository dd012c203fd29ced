"""Driver queries over the test tables, grouped by topic."""

from pulsefleet.plans import decisions, history, maintenance, operations, quality, sequential, statistics, streams  # noqa: F401
from pulsefleet.plans.registry import ORACLES, QUERIES, REPORTS

__all__ = ["ORACLES", "QUERIES", "REPORTS"]
