"""Stateful operators: request limits and resumable ingest."""
