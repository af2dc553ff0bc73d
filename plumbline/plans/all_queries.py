"""Collects every registered query."""

from __future__ import annotations

import importlib

from plumbline.plans.registry import ORACLES, QUERIES, Builder

AREAS = (
    "source_queries",
    "profile_queries",
    "cleaning_queries",
    "feature_queries",
    "sql_queries",
    "analysis_queries",
    "result_queries",
    "quality_queries",
    "similarity_queries",
    "run_queries",
    "stream_queries",
)


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"plumbline.plans.{area}")


def builders() -> dict[str, Builder]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
