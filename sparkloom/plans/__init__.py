"""Queries over the tables. Importing a module registers what it holds."""

from sparkloom.plans import io, joins, ordered, relational, scalars, sets, stateful, streams, udfs, windows  # noqa: F401
from sparkloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
