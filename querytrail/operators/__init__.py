"""Reusable DataFrame operators: joins, ordered windows, ranking, plot data."""
