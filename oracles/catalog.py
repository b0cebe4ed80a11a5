"""Every oracle by query name."""

from __future__ import annotations

from importlib import import_module

ORACLES: dict = {}
for _part in ("rating_sql", "ranking_sql", "analytics_sql", "market_sql", "etl_sql", "surface_sql", "io_sql"):
    ORACLES.update(import_module(f"oracles.{_part}").ORACLES)
