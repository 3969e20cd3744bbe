"""Loads every module that registers queries."""

from __future__ import annotations

import importlib

from storyloom.plans.registry import ORACLES, QUERIES

MODULES = ["feed_queries", "search_queries", "ingest_queries", "text_queries", "merge_queries", "extract_queries", "vector_queries", "stage_queries"]


def load():
    for name in MODULES:
        importlib.import_module(f"storyloom.plans.{name}")
    return QUERIES, ORACLES
