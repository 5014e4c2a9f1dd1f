"""All queries over the reference operators, with their SQL."""

from __future__ import annotations

from .plans import bytewise, coding, dictionaries, formats, grids, planes, series, sets, training  # noqa: F401 - they register
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
