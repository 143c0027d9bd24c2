"""All core queries and their SQL, collected from the modules of this package.

A module lists its queries in QUERIES: name -> (query, SQL for DuckDB or None).
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import cliploom.plans

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    names = sorted(m.name for m in pkgutil.iter_modules(cliploom.plans.__path__) if m.name != "registry")
    return [importlib.import_module(f"cliploom.plans.{n}") for n in names]


def queries() -> dict[str, Query]:
    return {name: q for m in _modules() for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, (_, sql) in m.QUERIES.items() if sql}
