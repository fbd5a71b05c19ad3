"""All registered queries; importing the package registers them."""

from tickloom.plans.catalog.registry import ORACLES, QUERIES
from tickloom.plans.catalog import (  # noqa: F401
    factor_queries,
    ingest_queries,
    live_queries,
    panel_queries,
    portfolio_queries,
    signal_queries,
    storage_queries,
)

__all__ = ["ORACLES", "QUERIES"]
