"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from stepwell import queries  # noqa: F401
from stepwell.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
