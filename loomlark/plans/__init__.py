"""Queries over the driver tables, grouped by block."""
