"""Decorator that turns a workspace function into a catalog query."""

from __future__ import annotations

from duelgrid.plans.workspace import workspace


def registrar():
    found: dict = {}

    def query(name: str):
        def wrap(fn):
            found[name] = lambda spark, sf_dir: fn(workspace(spark, sf_dir))
            return fn
        return wrap

    return found, query
