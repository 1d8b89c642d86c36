"""Catalog tables, snapshots and control-plane records as DataFrames."""
