"""Every registered query of the core, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that hold QUERIES and SQL.
MODULES: tuple[str, ...] = ("texts", "extraction", "search", "hybrid", "chains", "quality")


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in importlib.import_module(f"skerry.plans.{m}").QUERIES.items()}


def core_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in importlib.import_module(f"skerry.plans.{m}").SQL.items()}
