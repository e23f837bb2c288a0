"""Registered queries: each module binds operators to the driver's tables, with a DuckDB form beside."""

from . import boxes, catalogs, components, matches, models, names, streams
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "boxes", "catalogs", "components", "matches", "models", "names", "streams"]
