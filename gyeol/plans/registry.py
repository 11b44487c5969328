"""All queries outside the subpackage for language model data, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("general", "text", "search", "quality", "gate", "service", "review")


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"gyeol.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"gyeol.plans.{m}").SQL.items()}
