"""All queries of the core, with their SQL."""

from __future__ import annotations

from flowquarry.plans import filequeries, flowqueries, modelqueries, starqueries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (filequeries, flowqueries, starqueries, modelqueries):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
