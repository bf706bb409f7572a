"""All queries outside the training-data operators, with their SQL."""

from __future__ import annotations

from loam.plans import curation, details, service, store  # noqa: F401  they register themselves
from loam.plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
