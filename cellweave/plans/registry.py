"""All queries, in the order of their modules."""

from __future__ import annotations

from cellweave.plans import catalogue, model_queries, search_queries, shape_queries, stat_queries  # noqa: F401
from cellweave.plans.catalogue import Query


def queries() -> dict[str, Query]:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.ORACLES)
