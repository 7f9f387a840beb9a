"""Registry of named queries over a data folder, each with an optional DuckDB
oracle SQL text.  Query callables take ``(spark, data_dir)`` and return a
DataFrame; every one reads whole driver tables (or Spark-derived data)."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    section: str


_REGISTRY: dict[str, Entry] = {}

_MODULES = (
    "fundscope.plans.q_models",
    "fundscope.plans.q_columns",
    "fundscope.plans.q_tables",
    "fundscope.plans.q_quality",
    "fundscope.plans.q_stats",
    "fundscope.plans.q_rules",
    "fundscope.plans.q_sync",
    "fundscope.plans.q_ml",
    "fundscope.plans.q_retrieval",
)


def register(name: str, sql: str | None = None, section: str = ""):
    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Entry(name, fn, sql, section)
        return fn
    return deco


def entries() -> dict[str, Entry]:
    for m in _MODULES:
        importlib.import_module(m)
    return dict(_REGISTRY)
