"""All queries of the library with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from fieldloom.plans import checks, climate, domain, fits, forests, geodesy, grids, learning, maps, networks, relational, series, stacks, streams, tables, terrain, words  # noqa: F401  they register their queries
from fieldloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = "monthly_order_trend"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
