"""Query plans over the given tables."""

from __future__ import annotations

import importlib

MODULES = ["audit", "texts", "webpages", "matching", "metrics", "splits", "claims", "events", "evidence",
           "learning", "io", "streams"]


def load_all():
    from evidence_spark.plans.registry import QUERIES

    for name in MODULES:
        importlib.import_module(f"evidence_spark.plans.{name}")
    return QUERIES
