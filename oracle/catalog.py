"""All oracle statements."""

from __future__ import annotations

from oracle import consolidation_sql, dedup_sql, graph_sql, monitor_sql, retrieval_sql, streaming_sql, text_sql

MODULES = [text_sql, dedup_sql, graph_sql, retrieval_sql, consolidation_sql, monitor_sql, streaming_sql]
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
