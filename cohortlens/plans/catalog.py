"""All named queries and oracles, in the order of their modules."""

from __future__ import annotations

from . import fitting, grouping, interpreting, preferring, preparing
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "fitting", "grouping", "interpreting", "preferring", "preparing"]
