"""All queries of the library over the given tables, by name, and their SQL."""

from __future__ import annotations

from posegrid.plans import evaluation, files, geometry, graphs, nav, sampling, space, streams, texts

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in (nav, space, evaluation, geometry, texts, sampling, graphs, streams, files):
    QUERIES.update(module.QUERIES)
    ORACLE_SQL.update(module.SQL)
FLAGSHIP = "nav_metrics"
