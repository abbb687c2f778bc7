"""Queries of the engine's operators, with the SQL that should agree."""
