"""Every operator query by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from importlib import import_module

CATALOG: dict = {}
for _part in ("rating_queries", "ranking_queries", "analytics_queries", "market_queries", "etl_queries", "surface_queries", "io_queries"):
    CATALOG.update(import_module(f"duelgrid.plans.{_part}").QUERIES)
