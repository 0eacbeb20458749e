"""Registered queries over the relational tables and their SQL."""

from grainmill.plans.relational import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
