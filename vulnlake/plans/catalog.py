"""All registered queries."""

from vulnlake.plans import corpus_queries, report_queries, round_trip_queries, scan_queries, stream_queries  # noqa: F401
from vulnlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
