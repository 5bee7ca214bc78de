"""All registered queries and their SQL."""

from __future__ import annotations

from halyard.plans import corpora, corpus, evaluation, geometry, models, molecules, readers, streams, structures  # noqa: F401
from halyard.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
