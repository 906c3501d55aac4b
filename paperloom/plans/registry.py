"""All queries of the core with the SQL that checks them."""

from __future__ import annotations

from paperloom.plans import core_queries, golden_queries, nested_queries

QUERIES = {**nested_queries.QUERIES, **core_queries.QUERIES, **golden_queries.QUERIES}
ORACLES = {**nested_queries.ORACLES, **core_queries.ORACLES, **golden_queries.ORACLES}
