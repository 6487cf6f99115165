"""Composite plans: graph building, path search, route requests."""
