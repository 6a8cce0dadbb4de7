"""Incremental linkage of arriving gallery records."""
