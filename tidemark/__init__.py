"""Leakage-safe retrieval, risk control and corpus preparation as Spark jobs."""
