"""Queries over the test tables, each next to the SQL that states its result."""

from formlake.plans import curation, layout, medallion, records, retrieval, streams  # noqa: F401
from formlake.plans.registry import ORACLES, QUERIES  # noqa: F401
