"""Chronological splits that never divide a timestamp."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.functions.selection import totals_of, values_at_places
from tallystream.operators.checks import duplicate_keys, require_columns, shared_keys
from tallystream.sources.artifacts import checked_digest, opened, ordered_digest, sealed
from tallystream.sources.observed import checked_table
from tallystream.sources.shared import drop_table

MANIFEST = "split"


@dataclass(frozen=True)
class SplitConfig:
    fraction: float = 0.2
    time: str = "unix_time"
    display: str = "trans_date_trans_time"
    label: str = "is_fraud"
    key: str = "trans_num"

    def __post_init__(self):
        if not 0 < self.fraction < 1:
            raise ValueError("the validation fraction must lie between 0 and 1")
        if len({self.time, self.display, self.label, self.key}) < 4:
            raise ValueError("column roles must differ")


def boundary_time(df: DataFrame, time: str, fraction: float, rows: int | None = None) -> int:
    """The time at position floor(n (1 - fraction)) of the ordered rows; times are whole seconds."""
    times = df.select(F.col(time).cast("double").alias("t"))
    columns = {"t": F.col("t")}
    total = totals_of(times, columns)["t"] if rows is None else rows
    if not total:
        raise ValueError("nothing to split")
    place = min(total - 1, int(total * (1 - fraction)))
    return int(values_at_places(times, columns, {"t": {place}}, {"t": total})["t"][place])


def split(df: DataFrame, config: SplitConfig = SplitConfig()) -> tuple[DataFrame, DataFrame]:
    """(train, validation): rows before the boundary time, and the others. Both must have rows; keys must be unique and times
    known. The rows are read once for all checks: their keys and times are written."""
    require_columns(df, [config.time, config.key])
    table, n, _ = checked_table(df.select(F.col(config.time).alias("t"), F.col(config.key).alias("k")), "split-keys", {config.time: F.col("t").isNotNull()})
    if duplicate_keys(table, "k").limit(1).count():
        raise ValueError("keys repeat")
    at = boundary_time(table, "t", config.fraction, n)
    if not 0 < table.filter(F.col("t") < at).count() < n:
        raise ValueError("a split side is empty")
    drop_table(table)
    return df.filter(F.col(config.time) < at), df.filter(F.col(config.time) >= at)


def partition_column(time: Column, boundary: int) -> Column:
    return F.when(time < boundary, "train").otherwise("validation")


def partition_summary(df: DataFrame, partition: str, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Per partition: rows, labels, rate, and first and last time."""
    bad = F.count_if(F.col(config.label) == 1)
    return df.groupBy(partition).agg(
        F.count("*").alias("rows"), F.count_if(F.col(config.label) == 0).alias("negatives"), bad.alias("positives"), (bad / F.count("*")).alias("rate"),
        F.min(config.time).alias("first_time"), F.max(config.time).alias("last_time"),
    )


def split_manifest(development: DataFrame, holdout: DataFrame, config: SplitConfig = SplitConfig()) -> dict:
    """The record of a three-way split; the holdout must have the same columns, other keys, and be strictly later."""
    if development.columns != holdout.columns:
        raise ValueError("the tables have different columns")
    if shared_keys(development, holdout, config.key).limit(1).count():
        raise ValueError("the tables share keys")
    if duplicate_keys(holdout, config.key).limit(1).count():
        raise ValueError("keys repeat")
    train, validation = split(development, config)
    parts = {"train": train, "validation": validation, "holdout": holdout}
    roles = {"time": config.time, "label": config.label, "key": config.key}
    out: dict = {"type": MANIFEST, "version": 1, "fraction": config.fraction, "roles": roles, "columns": development.columns, "partitions": {}}
    for name, part in parts.items():
        row = partition_summary(part.withColumn("__part", F.lit(name)), "__part", config).first()
        if row is None:
            raise ValueError(f"{name} is empty")
        out["partitions"][name] = {k: v for k, v in row.asDict().items() if k != "__part"} | {"key_sha256": ordered_digest(part, config.key, config.time)}
    gap = out["partitions"]["holdout"]["first_time"] - out["partitions"]["validation"]["last_time"]
    if gap <= 0:
        raise ValueError("the holdout does not start after the development rows")
    return sealed(out | {"gap_seconds": gap, "boundary_time": out["partitions"]["validation"]["first_time"]})


def load_manifest(document: dict) -> dict:
    """The manifest, after its digest, type, partitions and fields were verified."""
    found = opened(document, kind=MANIFEST, version=1)
    if set(found.get("partitions", {})) != {"train", "validation", "holdout"} or not {"fraction", "roles", "columns", "gap_seconds", "boundary_time"} <= set(found):
        raise ValueError("the manifest is not complete")
    for name, part in found["partitions"].items():
        if missing := {"rows", "negatives", "positives", "rate", "first_time", "last_time", "key_sha256"} - set(part):
            raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
        checked_digest(part["key_sha256"])
        if part["rows"] < 1 or part["negatives"] + part["positives"] != part["rows"] or part["first_time"] > part["last_time"]:
            raise ValueError(f"{name} does not add up")
    train, validation, holdout = (found["partitions"][p] for p in ("train", "validation", "holdout"))
    if not train["last_time"] < validation["first_time"] == found["boundary_time"] or holdout["first_time"] - validation["last_time"] != found["gap_seconds"] or found["gap_seconds"] <= 0:
        raise ValueError("the partitions are not in order of time")
    return found


def check_partition(df: DataFrame, manifest: dict, name: str) -> None:
    """Raise unless the rows are those of the manifest's partition: their number, labels, times and keys."""
    found = load_manifest(manifest)
    roles = found["roles"]
    config = SplitConfig(found["fraction"], roles["time"], label=roles["label"], key=roles["key"])
    row = partition_summary(df.withColumn("__part", F.lit(name)), "__part", config).first()
    own = {k: v for k, v in row.asDict().items() if k != "__part"} | {"key_sha256": ordered_digest(df, config.key, config.time)} if row else {}
    if wrong := sorted(k for k, v in found["partitions"][name].items() if own.get(k) != v):
        raise ValueError(f"the rows are not those of {name}: {', '.join(wrong)}")
