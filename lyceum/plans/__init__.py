"""Registered queries over the benchmark tables, each with its DuckDB counterpart."""
