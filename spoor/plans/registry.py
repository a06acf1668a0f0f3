"""All registered queries."""

from __future__ import annotations

from importlib import import_module

AREAS = ["functions", "events", "files", "process", "search", "cases", "sources"]

QUERIES: dict = {}
ORACLES: dict = {}
for area in AREAS:
    module = import_module(f"spoor.plans.{area}")
    repeated = QUERIES.keys() & module.QUERIES.keys()
    if repeated:
        raise ValueError(f"registered twice: {sorted(repeated)}")
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
