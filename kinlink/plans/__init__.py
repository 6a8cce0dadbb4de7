"""Named queries, end-to-end runs and fixtures."""
