"""All queries of the catalogue and their DuckDB counterparts."""

from __future__ import annotations

from . import distributed, extended  # noqa: F401  they register their queries
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
