"""Retention operators: quality, profiling, splitting, preparation, metrics, targeting."""
