"""Registered queries."""

from . import more, reads, rewrites  # noqa: F401  they register their queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
