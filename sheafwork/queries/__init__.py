"""Queries of the document engine, and the SQL that states each result."""

from sheafwork.queries import diagnostics, matching, outcomes, packets, scalars, storage  # noqa: F401
from sheafwork.queries.registry import ORACLE_SQL, QUERIES  # noqa: F401
