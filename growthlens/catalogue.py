"""All queries of the library with the SQL they are held against."""

from __future__ import annotations

from growthlens.plans import aggregates, curves, history, models, scalars, spatial  # noqa: F401  each registers its queries
from growthlens.plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
