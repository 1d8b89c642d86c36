"""Whole requests composed from the operators."""
