"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from pulsegrid.plans import dataset_queries, kernel_queries, signal_queries, store_queries  # noqa: F401  they register their queries
from pulsegrid.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
