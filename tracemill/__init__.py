"""Typed relations, read-only SQL and immutable outputs on Spark."""
