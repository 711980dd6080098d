"""DuckDB statements that recompute the registered queries independently."""
