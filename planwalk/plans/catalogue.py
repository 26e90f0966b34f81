"""All queries of the engine by name, with DuckDB SQL for the same results."""

from __future__ import annotations

from planwalk.plans import catalogue_queries, circle_queries, raster_queries, request_queries, scoring_queries, semantic_queries, spatial_queries, validation_queries  # noqa: F401
from planwalk.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
