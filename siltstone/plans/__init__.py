"""Registered queries of the keyed-table engine and their SQL twins."""

from siltstone.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
