"""Registered queries, each with an equivalent in SQL where there is one."""

from quire.plans import artifacts, chains, checks, frames, functions, journal, nested, pages, resolution, resources, scheduling  # noqa: F401  each registers its queries
from quire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
