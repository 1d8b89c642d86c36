"""Refresh of derived tables when a snapshot arrives."""
