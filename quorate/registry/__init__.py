"""Queries by area: each module has QUERIES (name -> callable) and SQL (name -> text for DuckDB)."""
