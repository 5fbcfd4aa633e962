"""Latency of scorers that are already loaded, over inputs that are already prepared."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Batch sizes, calls before measuring, and measured calls.
SIZES, WARM_UPS, REPEATS = (1, 32, 256), 3, 20
SCHEMA = "model string, batch int, repeats int, p50_ms double, p95_ms double, p99_ms double, p50_ms_per_row double, rows_per_second double"


def measured(name: str, score: Callable[[int], object], rows: int, *, sizes: tuple[int, ...] = SIZES, warm_ups: int = WARM_UPS, repeats: int = REPEATS) -> list[tuple]:
    """A row of ``SCHEMA`` for each batch size; ``score(n)`` scores the first n of ``rows`` prepared rows."""
    if warm_ups < 0 or repeats < 1 or any(not 1 <= n <= rows for n in sizes):
        raise ValueError("batch sizes must lie within the rows, and calls must be measured")
    out = []
    for n in sizes:
        for _ in range(warm_ups):
            score(n)
        took = []
        for _ in range(repeats):
            start = time.perf_counter_ns()
            score(n)
            took.append((time.perf_counter_ns() - start) / 1e6)
        p50, p95, p99 = (float(x) for x in np.quantile(took, [0.5, 0.95, 0.99]))
        out.append((name, n, repeats, p50, p95, p99, p50 / n, n / max(p50, 1e-9) * 1000))
    return out


def latency_table(spark: SparkSession, scorers: dict[str, Callable[[int], object]], rows: int, **options: int) -> DataFrame:
    """Latency of every scorer, as a table to join with quality and sizes (``fusion.tradeoff`` takes the column ``batch``)."""
    return spark.createDataFrame([r for name, score in scorers.items() for r in measured(name, score, rows, **options)], SCHEMA)
