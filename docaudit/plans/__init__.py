"""Whole jobs: sources, operators and results put together."""
