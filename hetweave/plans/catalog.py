"""The catalogue of queries over the test tables, and their SQL."""

from __future__ import annotations

from hetweave.plans import analytics, evaluation, guards, reduction, selection, similarity  # noqa: F401  they register their queries
from hetweave.plans.registry import ORACLES, QUERIES, Query

__all__ = ["ORACLES", "QUERIES", "Query"]
