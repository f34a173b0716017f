"""Registered query plans and their DuckDB oracle SQL."""
