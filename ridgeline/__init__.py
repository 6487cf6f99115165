"""Elevation-aware route analytics on Spark."""
