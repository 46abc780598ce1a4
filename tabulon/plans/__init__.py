"""Registered queries over the standard tables, with equivalent SQL for DuckDB."""
