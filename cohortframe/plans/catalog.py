"""All named queries."""

from __future__ import annotations

from cohortframe.plans import group_queries, iterative_queries, model_queries, shape_queries  # noqa: F401
from cohortframe.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
