"""Syntax trees to typed Spark columns."""
