"""Relational operators on road tables. Each takes and returns DataFrames."""
