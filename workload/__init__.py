"""Registered queries over the given tables, and SQL for the same answers."""
