"""Ranked-graph analytics on Spark."""
