"""All corpus queries and their SQL."""

from __future__ import annotations

from memlake.llm import queries_a, queries_b, queries_c, queries_d, queries_e

MODULES = [queries_a, queries_b, queries_c, queries_d, queries_e]
QUERIES = {name: fn for module in MODULES for name, fn in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
