"""All registered queries."""

from rankflow.catalog import (  # noqa: F401
    aggregates,
    exchanges,
    files,
    functions,
    projections,
    sets,
    streams,
    tasks,
    windows,
)
from rankflow.catalog.registry import QUERIES

__all__ = ["QUERIES"]
