"""Exports and materialised results."""
