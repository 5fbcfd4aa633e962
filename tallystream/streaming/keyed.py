"""Causal activity as a stream on keyed states: maps of buckets, timers that expire them, and an initial state.

The buckets of an entity (a count and cents for each second) lie in slots of its state's map, some dozens to the longest window. A
value state holds the open second, the lifetime's totals, and for each window its sums and the time from which on they count. An
event adds to the sums and moves the edges on: only the slots that an edge passes are read, once a batch, so the work of an event
does not depend on the number of buckets. Slots that the longest window has left are removed when the entity moves on, and those
of an entity that is silent by timers of event time.

A row earlier than its entity's open second, or than a watermark by which buckets were removed, is an error or is marked, as
configured; the watermark itself drops nothing, since rows go to the states without the column it is on.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallystream.functions.scalars import cents
from tallystream.operators.velocity import VelocityConfig

HEAD = "open long, open_n long, open_cents long, total_n long, total_cents long, edges array<long>, counts array<long>, sums array<long>, kept array<long>, clock long"
SLOT = "times array<long>, counts array<long>, sums array<long>"
#: Slots of the longest window.
SLOTS = 32
#: The state store that these states need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def slot_seconds(config: VelocityConfig) -> int:
    return max(1, -(-max(config.windows) // SLOTS))


class Activity:
    """One entity's activity over its states: ``load`` and ``save`` slots by number, ``drop`` them."""

    def __init__(self, windows: tuple[int, ...], width: int, head: tuple | None, load, save, drop):
        self.windows, self.width, self._load, self._save, self._drop = windows, width, load, save, drop
        k = len(windows)
        self.open, self.open_n, self.open_cents, self.total_n, self.total_cents, edges, counts, sums, kept, self.clock = head or (None, 0, 0, 0, 0, [None] * k, [0] * k, [0] * k, [], None)
        self.edges, self.counts, self.sums, self.kept = list(edges), list(counts), list(sums), list(kept)
        self.stored = set(self.kept)
        self.slots: dict[int, tuple[list, list, list]] = {}
        self.changed: set[int] = set()
        self.made: list[int] = []

    def head(self) -> tuple:
        return (self.open, self.open_n, self.open_cents, self.total_n, self.total_cents, self.edges, self.counts, self.sums, self.kept, self.clock)

    def slot(self, number: int) -> tuple[list, list, list]:
        if number not in self.slots:
            found = self._load(number) if number in self.stored else None
            self.slots[number] = tuple(list(x) for x in found) if found else ([], [], [])
        return self.slots[number]

    def put(self, t: int, n: int, c: int) -> None:
        """A closed bucket, later than all others; after an expiry it may have left some windows, or all."""
        inside = [edge is None or t >= edge for edge in self.edges]
        for i in range(len(self.windows)):
            if inside[i]:
                self.counts[i], self.sums[i] = self.counts[i] + n, self.sums[i] + c
        if not any(inside):
            return
        number = t // self.width
        for x, value in zip(self.slot(number), (t, n, c), strict=True):
            x.append(value)
        self.changed.add(number)
        if number not in self.kept:
            self.kept.append(number)
            self.made.append(number)

    def move(self, t: int) -> None:
        """Windows that end at ``t``: subtract what they leave, and remove the slots that all have left."""
        for i, w in enumerate(self.windows):
            low, high = self.edges[i], t - w
            if low is not None and high <= low:
                continue
            for number in self.kept:
                if number * self.width >= high:
                    break
                if low is not None and (number + 1) * self.width <= low:
                    continue
                times, counts, sums = self.slot(number)
                a, b = 0 if low is None else bisect_left(times, low), bisect_left(times, high)
                self.counts[i], self.sums[i] = self.counts[i] - sum(counts[a:b]), self.sums[i] - sum(sums[a:b])
            self.edges[i] = high
        gone = [number for number in self.kept if (number + 1) * self.width <= t - max(self.windows)]
        for number in gone:
            if number in self.stored:  # else it never left this batch: the store is not asked
                self._drop(number)
            self.slots.pop(number, None)
            self.changed.discard(number)
        self.kept = self.kept[len(gone) :]

    def add(self, t: int, cents: int) -> list[int] | None:
        """Counts and cents of each window and of the lifetime before ``t``; None for an event that comes too late."""
        if (self.open is not None and t < self.open) or (self.clock is not None and t < self.clock):
            return None
        if self.open is None or t > self.open:
            if self.open_n:
                self.put(self.open, self.open_n, self.open_cents)
                self.total_n, self.total_cents = self.total_n + self.open_n, self.total_cents + self.open_cents
            self.open, self.open_n, self.open_cents = t, 0, 0
            self.move(t)
        self.open_n, self.open_cents = self.open_n + 1, self.open_cents + cents
        return [x for pair in zip(self.counts, self.sums, strict=True) for x in pair] + [self.total_n, self.total_cents]

    def expire(self, clock: int) -> None:
        """No row earlier than ``clock`` comes any more."""
        if self.clock is None or clock > self.clock:
            self.clock = clock
            self.move(clock)

    def flush(self) -> None:
        for number in self.changed:
            self._save(number, self.slots[number])
            self.stored.add(number)


class ActivityProcessor(StatefulProcessor):
    """The handler of ``keyed_velocity``."""

    def __init__(self, config: VelocityConfig, key: str, on_late: str):
        self.config, self.key, self.on_late = config, key, on_late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getValueState("head", HEAD)
        self.slots = handle.getMapState("slots", "slot long", SLOT)

    def _activity(self) -> Activity:
        load = lambda n: self.slots.getValue((n,))
        save = lambda n, x: self.slots.updateValue((n,), x)
        return Activity(self.config.windows, slot_seconds(self.config), self.heads.get(), load, save, lambda n: self.slots.removeKey((n,)))

    def _keep(self, activity: Activity) -> None:
        activity.flush()
        for number in activity.made:
            if number in activity.stored and number in activity.kept:
                self.handle.registerTimer(((number + 1) * activity.width + max(self.config.windows)) * 1000)
        self.heads.update(activity.head())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        data = parts[0] if len(parts) == 1 else pd.concat(parts)
        if len(data) > 1:
            data = data.sort_values(["t", "key"], kind="stable")
        activity, names, out = self._activity(), self.config.names(), []
        keys, times = data["key"].tolist(), data["t"].tolist()
        for t, amount in zip(times, data["cents"].tolist(), strict=True):
            got = activity.add(t, amount)
            if got is None and self.on_late == "raise":
                raise ValueError(f"an event of {key[0]} at {t} is earlier than one at {activity.open}, or than the watermark")
            out.append(got)
        self._keep(activity)
        # By columns: what an entity's few rows cost is mostly the table around them.
        late = [got is None for got in out]
        columns: dict = {"entity": [key[0]] * len(out), "key": keys, "t": times, "late": late}
        for i, name in enumerate(names):
            values = [None if got is None else got[i] if i % 2 == 0 else got[i] / 100.0 for got in out]
            columns[name] = pd.Series(values, dtype=object) if any(late) else values
        yield pd.DataFrame(columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.heads.exists():
            activity = self._activity()
            activity.expire(expiredTimerInfo.getExpiryTimeInMs() // 1000)
            self._keep(activity)
        return iter([])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        activity = self._activity()
        for t, n, c in zip(row["times"], row["counts"], row["sums"], strict=True):
            activity.put(int(t), int(n), int(c))
        activity.open, activity.open_n, activity.open_cents, activity.total_n, activity.total_cents = (int(row[c]) for c in ("open", "open_n", "open_cents", "total_n", "total_cents"))
        activity.move(activity.open)
        self._keep(activity)

    def close(self) -> None:
        pass


def keyed_velocity(events: DataFrame, config: VelocityConfig, key: str, *, snapshot: DataFrame | None = None, delay: str = "0 seconds", on_late: str = "raise") -> DataFrame:
    """(entity, key, time, late, and the columns of ``config.names()``) of a stream of events, with the output mode append.

    A stream that goes on from a ``snapshot`` sees its activity. The state of an entity that is silent shrinks to its totals and
    open second, once the watermark (``delay`` behind the latest event of all) has passed its buckets by the longest window; its
    rows earlier than that are late from then on. ``on_late``: raise, or mark (with nulls). Null entities are one entity.
    """
    if on_late not in ("raise", "mark"):
        raise ValueError("late events are raised or marked")
    spark, kinds = events.sparkSession, dict(events.dtypes)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    seconds = F.col(config.time).cast("long")
    source = events.withColumn("__at", F.timestamp_seconds(seconds)).withWatermark("__at", delay)
    source = source.select(F.col(config.entity).alias("entity"), F.col(key).alias("key"), seconds.alias("t"), cents(F.col(config.amount)).alias("cents"))
    columns = ", ".join(f"`{n}` {'long' if i % 2 == 0 else 'double'}" for i, n in enumerate(config.names()))
    schema = f"entity {kinds[config.entity]}, key {kinds[key]}, t long, late boolean, {columns}"
    first = None if snapshot is None else snapshot.withColumn("entity", F.col("entity").cast(kinds[config.entity])).groupBy("entity")
    return source.groupBy("entity").transformWithStateInPandas(ActivityProcessor(config, key, on_late), schema, "Append", "EventTime", initialState=first)


def stream_snapshot(spark: SparkSession, checkpoint: str, config: VelocityConfig) -> DataFrame:
    """The states of a stream of ``keyed_velocity``, read from its checkpoint: the snapshot that another one starts from."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    heads = read("head").select(F.col("key.entity").alias("entity"), F.col("value.*"))
    slots = read("slots").select(F.col("key.entity").alias("__e"), F.inline(F.arrays_zip(F.col("user_map_value.times").alias("t"), F.col("user_map_value.counts").alias("n"), F.col("user_map_value.sums").alias("c"))))
    past = slots.groupBy("__e").agg(F.array_sort(F.collect_list(F.struct("t", "n", "c"))).alias("past"))
    inside = lambda b: b["t"] >= F.col("open") - max(config.windows)
    kept = F.filter(F.coalesce("past", F.array().cast("array<struct<t:bigint,n:bigint,c:bigint>>")), inside)
    out = heads.join(past, F.col("entity").eqNullSafe(F.col("__e")), "left").withColumn("past", kept)
    return out.select("entity", "open", "open_n", "open_cents", "total_n", "total_cents", *[F.col(f"past.{c}").alias(name) for c, name in (("t", "times"), ("n", "counts"), ("c", "sums"))])
