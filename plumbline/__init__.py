"""Grounded text analytics on Spark."""
