"""All registered queries."""

from __future__ import annotations

from memlake.plans import consolidation_queries, dedup_queries, graph_queries, monitor_queries, retrieval_queries, streaming_queries, text_queries

MODULES = [text_queries, dedup_queries, retrieval_queries, graph_queries, consolidation_queries, monitor_queries,
           streaming_queries]
QUERIES = {name: fn for module in MODULES for name, fn in module.QUERIES.items()}
