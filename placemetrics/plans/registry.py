"""All registered queries and their SQL."""

from __future__ import annotations

from placemetrics.plans import benchmark_queries, catalog_queries, finance_queries, matching_queries, notice_queries, panel_queries, source_queries, survival_queries

MODULES = [panel_queries, survival_queries, benchmark_queries, finance_queries, notice_queries, catalog_queries, matching_queries, source_queries]
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: text for m in MODULES for name, text in m.ORACLE.items()}
