"""Causal transaction analytics on Spark."""
