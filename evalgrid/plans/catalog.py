"""Imports the modules that register queries."""

from __future__ import annotations

import importlib

from evalgrid.plans import QUERIES, Query

MODULES = ("records", "matrix", "texts", "vectors", "gates", "leaks", "trials", "sites", "recipes", "solvers", "trees")
FLAGSHIP = "ag01_episode_aggregate"


def load() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"evalgrid.plans.{name}")
    return QUERIES
