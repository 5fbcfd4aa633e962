"""Checks and counts that ride on the write of a table: its input is read once, and a table that breaks a rule is not kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallystream.sources.shared import drop_table, written


def observed(df: DataFrame, write: Callable[[DataFrame], object], rules: dict[str, Column], more: dict[str, Column] | None = None) -> dict:
    """Run ``write`` on ``df`` and return the number of rows (``rows``), the rows that break each rule (``broken``) and the
    aggregates ``more`` (``found``), all of that one pass."""
    seen, more = Observation(), more or {}
    metrics = [F.count(F.lit(1)).alias("n"), *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())], *[c.alias(f"m{i}") for i, c in enumerate(more.values())]]
    write(df.observe(seen, *metrics))
    values = seen.get
    return {"rows": values["n"], "broken": {k: v for i, k in enumerate(rules) if (v := values[f"r{i}"])}, "found": {k: values[f"m{i}"] for i, k in enumerate(more)}}


def refuse(broken: dict[str, int]) -> None:
    """Raise a ValueError that names the rules that rows break."""
    if broken:
        raise ValueError("invalid rows: " + ", ".join(f"{k} ({v})" for k, v in sorted(broken.items())))


def checked_table(df: DataFrame, name: str, rules: dict[str, Column], more: dict[str, Column] | None = None) -> tuple[DataFrame, int, dict]:
    """(table in the shared folder, rows, aggregates) of ``df``, after every row was found to satisfy the rules."""
    made: list[DataFrame] = []
    out = observed(df, lambda d: made.append(written(d, name)), rules, more)
    if out["broken"]:
        drop_table(made[0])
        refuse(out["broken"])
    return made[0], out["rows"], out["found"]
