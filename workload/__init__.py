"""Queries over the test tables and their DuckDB counterparts."""
