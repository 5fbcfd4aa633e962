"""States of entities that a scoring session goes on from: activity and bounded histories together.

A state has the columns of an activity snapshot, ``past`` (the last items of different seconds, the open one included, oldest
first) and ``seeded`` (whether it was there when the session's store was made). Rows of one second see the same past; the row of
the smallest key stands for its second.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.operators.velocity import VelocityConfig
from tallystream.streaming.activity import advanced_snapshot, refuse_late, state_snapshot

ACTIVITY = ["open", "open_n", "open_cents", "total_n", "total_cents", "times", "counts", "sums"]


@dataclass(frozen=True)
class EntitySpec:
    """Windows and columns of the activity, the length of a history (the row itself included), and its key and item columns."""

    config: VelocityConfig
    length: int
    key: str
    item: str

    def __post_init__(self):
        if self.length < 1:
            raise ValueError("a history has at least one item")


def _same() -> Column:
    return F.col("entity").eqNullSafe(F.col("__e"))


def _seconds(rows: DataFrame, spec: EntitySpec) -> DataFrame:
    """(entity, t, key, item) of the row that stands for each second of an entity."""
    c = spec.config
    named = rows.select(F.col(c.entity).alias("entity"), F.col(c.time).cast("long").alias("t"), F.col(spec.key).cast("string").alias("key"), F.col(spec.item).alias("item"))
    return named.groupBy("entity", "t").agg(F.min(F.struct("key", "item")).alias("m")).select("entity", "t", "m.*")


def _last_items(seconds: DataFrame, length: int) -> DataFrame:
    """(entity, past): a bounded number of items, cut off before they are gathered."""
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("t")))
    last = seconds.withColumn("__n", rank).filter(F.col("__n") <= length)
    return last.groupBy(F.col("entity").alias("__e")).agg(F.array_sort(F.collect_list(F.struct("t", "key", "item"))).alias("past"))


def entity_states(history: DataFrame, spec: EntitySpec) -> DataFrame:
    """The states after all rows of ``history``."""
    past = _last_items(_seconds(history, spec), spec.length)
    return state_snapshot(history, spec.config).join(past, _same()).select("entity", *ACTIVITY, "past", F.lit(True).alias("seeded"))


def with_history(rows: DataFrame, states: DataFrame, spec: EntitySpec, name: str = "history") -> DataFrame:
    """Add the array of at most ``length`` items, oldest first, that ends with the row itself, from the states and earlier rows;
    and ``seeded``."""
    own, c = _seconds(rows, spec), spec.config
    old = states.select("entity", F.inline("past"))
    both = own.unionByName(old).groupBy("entity", "t").agg(F.min(F.struct("key", "item")).alias("m"))
    before = Window.partitionBy("entity").orderBy("t").rowsBetween(-(spec.length - 1), -1)
    held = F.transform(F.collect_list(F.struct("m.item")).over(before), lambda x: x["item"]) if spec.length > 1 else F.array().cast(rows.select(F.array(spec.item)).schema[0].dataType)
    past = both.select(F.col("entity").alias("__e"), F.col("t").alias("__t"), held.alias("__past"))
    known = states.filter("seeded").select(F.col("entity").alias("__k"), F.lit(True).alias("__s"))
    out = rows.join(past, F.col(c.entity).eqNullSafe(F.col("__e")) & (F.col(c.time) == F.col("__t"))).join(known, F.col(c.entity).eqNullSafe(F.col("__k")), "left")
    return out.select(*rows.columns, F.concat("__past", F.array(F.col(spec.item))).alias(name), F.coalesce("__s", F.lit(False)).alias("seeded"))


def advanced_states(states: DataFrame, rows: DataFrame, spec: EntitySpec) -> DataFrame:
    """The states after further rows. Rows earlier than an entity's open second are an error."""
    refuse_late(rows, states, spec.config)
    activity = advanced_snapshot(states.select("entity", *ACTIVITY), rows, spec.config)
    seconds = _seconds(rows, spec).unionByName(states.select("entity", F.inline("past"))).groupBy("entity", "t").agg(F.min(F.struct("key", "item")).alias("m")).select("entity", "t", "m.*")
    known = states.filter("seeded").select(F.col("entity").alias("__k"), F.lit(True).alias("__s"))
    out = activity.join(_last_items(seconds, spec.length), _same()).join(known, F.col("entity").eqNullSafe(F.col("__k")), "left")
    return out.select("entity", *ACTIVITY, "past", F.coalesce("__s", F.lit(False)).alias("seeded"))
