"""Every registered query of the retrieval library, with its SQL."""

from __future__ import annotations

from prismrank.plans import report_queries, retrieval_queries  # noqa: F401  register
from prismrank.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
