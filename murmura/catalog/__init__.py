"""Registered queries with their DuckDB text, over the shared test tables."""
