"""Registered queries of the business operators, each with its oracle where SQL can say it."""

from shelfspark.plans import (
    asof_queries,
    attribute_queries,
    conform_queries,
    demand_queries,
    feedback_queries,
    forecast_queries,
    planning_queries,
    policy_queries,
    profile_queries,
    quality_queries,
    service_queries,
    sheet_queries,
    supply_queries,
)
from shelfspark.plans.fixtures import QUERIES, oracles

__all__ = [
    "QUERIES",
    "oracles",
    "asof_queries",
    "attribute_queries",
    "conform_queries",
    "demand_queries",
    "feedback_queries",
    "forecast_queries",
    "planning_queries",
    "policy_queries",
    "profile_queries",
    "quality_queries",
    "service_queries",
    "sheet_queries",
    "supply_queries",
]
