"""Registered queries over the driver's tables."""

from nichelens.plans import (  # noqa: F401
    document_queries,
    import_queries,
    market_queries,
    schedule_queries,
    stream_queries,
)
from nichelens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
