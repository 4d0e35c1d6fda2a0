"""Registered queries over the driver tables, each with the SQL that checks it."""

from stepledger_queries import (  # noqa: F401
    aggregates,
    joins,
    lineage,
    ordered,
    plans,
    reconciliation,
    rows,
    scalars,
    sources,
    stacking,
)
from stepledger_queries.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
