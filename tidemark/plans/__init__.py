"""Registered queries and their reference SQL."""

from __future__ import annotations

import importlib

from .registry import REGISTRY, Query

_MODULES = ("features", "alignment", "crosssection", "tablechecks", "statistics", "resampling",
            "accounting", "events", "learning", "streams", "replications")


def catalogue() -> dict[str, Query]:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return dict(REGISTRY)
