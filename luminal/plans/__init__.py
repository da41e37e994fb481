"""Queries over the driver's tables, one module a category, each with the SQL that gives the same rows."""

from luminal.plans import expressions, groups, joins, more, placement, reading, rest, stored, streams  # noqa: F401
from luminal.plans.book import ORACLE_SQL, QUERIES  # noqa: F401
