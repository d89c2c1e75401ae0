"""All queries of the core library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "discrimination_ratio"
#: Modules with QUERIES (name to callable) and SQL (name to text).
MODULES = ["flows", "dialogues", "reports", "hierarchies", "windows"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"flowspark.plans.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"flowspark.plans.{m}").SQL
    return out
