"""Tabular profiling and term standardisation on Spark."""
