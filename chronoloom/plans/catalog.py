"""All registered queries of the time-series part and their SQL."""

from __future__ import annotations

from chronoloom.plans import registry
from chronoloom.plans import q_aggregates, q_context, q_joins, q_recursive, q_reports, q_response, q_reviews, q_stages, q_whole, q_windows  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
