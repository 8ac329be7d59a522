"""Queries over the driver tables."""
