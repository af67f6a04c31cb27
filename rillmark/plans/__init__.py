"""Named queries over the given tables."""

from rillmark.plans import connectors, extraction, filters, joining, models, statistics, streams, threats  # noqa: F401
from rillmark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
