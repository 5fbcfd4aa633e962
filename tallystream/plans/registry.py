"""Named queries over the tables, and the DuckDB SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package, each with QUERIES (name: function) and SQL (name: text).
MODULES = ["activity", "profiles", "preparing", "quality", "learning", "storage", "sessions", "trees"]


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"tallystream.plans.{name}"), what)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
