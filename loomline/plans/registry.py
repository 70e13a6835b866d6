"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from . import code_queries, general, general_sql, graph_queries, meta_queries, search_queries

PARTS = (graph_queries, search_queries, code_queries, meta_queries)
FLAGSHIP = "g09_downstream"
QUERIES = general.QUERIES | {k: f for part in PARTS for k, f in part.QUERIES.items()}
ORACLES = general_sql.ORACLES | {k: s for part in PARTS for k, s in part.ORACLES.items()}
