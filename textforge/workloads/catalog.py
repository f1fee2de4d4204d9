"""All registered queries with their SQL counterparts."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

for _area in ("preparation", "chat", "tokens", "scoring", "generation", "comparison", "incremental"):
    _module = importlib.import_module(f"textforge.workloads.{_area}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
