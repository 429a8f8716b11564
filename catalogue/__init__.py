"""Named queries over the test tables, each next to the SQL that states its expected result.

Every query runs over whole tables. Counts are BIGINT, statistics are rounded, undefined statistics are NULL.
"""

from catalogue import charts, compare, describe, facts, ingest, narrative, profile, tables  # noqa: F401
from catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
