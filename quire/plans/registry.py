"""All registered queries of the library's own operators, and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PARTS = ("search", "rules", "geometry", "links", "fonts", "layout", "state", "scalars", "assets")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for part in PARTS:
        found |= {f.__name__: f for f in importlib.import_module(f"quire.plans.{part}").QUERIES}
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for part in PARTS:
        found |= importlib.import_module(f"quire.plans.{part}").SQL
    return found
