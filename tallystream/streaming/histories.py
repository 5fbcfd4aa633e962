"""Bounded histories as a stream or session, with state per entity.

Events of one second see the same history; the one of the smallest key becomes the item that later events see.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallystream.operators.sequences import latest_per_entity
from tallystream.operators.velocity import VelocityConfig
from tallystream.streaming.activity import ActivityState


@dataclass
class HistoryState:
    """At most ``length`` - 1 past items, and the open second with the item that stands for it."""

    length: int
    items: list = field(default_factory=list)
    open: int | None = None
    key: str | None = None
    item: object = None
    shared: bool = True

    def advance(self, t: int, key: str, item: object) -> list:
        """The history that ends with the event itself, oldest first."""
        if self.open is not None and t < self.open:
            raise ValueError(f"an event at {t} is earlier than one at {self.open}")
        if self.open is None or t > self.open or not self.shared:
            if self.open is not None:
                self.items = [*self.items, self.item][-(self.length - 1) :] if self.length > 1 else []
            self.open, self.key, self.item = t, key, item
            return [*self.items, item]
        if key < self.key:
            self.key, self.item = key, item
        return [*self.items, item]


def stream_histories(events: DataFrame, length: int, *, entity: str, time: str, key: str, item: str, shared: bool = True) -> DataFrame:
    """(entity, key, t, history): an array of items for each event of a stream. Late events are an error. Events of one time see the
    same history, or, where it is not ``shared``, each one those before it, by their keys as text. Null items stay null."""
    kinds = dict(events.dtypes)
    source = events.select(F.col(entity).alias("entity"), F.col(key).cast("string").alias("key"), F.col(time).cast("long").alias("t"), F.col(item).alias("item"), F.col(item).isNull().alias("empty"))

    def handle(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t", "key"], kind="stable")
        kept = HistoryState(length, *(([], None, None, None) if not state.exists else (list(state.get[0]), *state.get[1:])), shared)
        out = [[who[0], k, t, kept.advance(int(t), k, None if empty else x)] for k, t, x, empty in zip(rows["key"], rows["t"], rows["item"], rows["empty"], strict=True)]
        state.update((kept.items, kept.open, kept.key, kept.item))
        yield pd.DataFrame(out, columns=["entity", "key", "t", "history"])

    kind = kinds[item]
    return source.groupBy("entity").applyInPandasWithState(handle, f"entity {kinds[entity]}, key string, t long, history array<{kind}>", f"items array<{kind}>, open long, key string, item {kind}", "append", GroupStateTimeout.NoTimeout)


def history_context(df: DataFrame, length: int, *, entity: str, time: str, key: str, row: str, item: str) -> DataFrame:
    """What a session starts from: per entity the past items (not the open one), and the open second, its key and item."""
    from tallystream.operators.sequences import add_history

    last = latest_per_entity(add_history(df, length, entity=entity, time=time, key=key, row=row, name="__h", value=item), entity=entity, time=time, key=key, row=row)
    return last.select(F.col(entity).alias("entity"), F.slice("__h", 1, F.size("__h") - 1).alias("items"), F.col(time).alias("open"), F.col(key).cast("string").alias("key"), F.col(item).alias("item"))


class Session:
    """Scores batches of events against states of their own; a batch takes effect as a whole, or, as a preview, not at all."""

    def __init__(self, config: VelocityConfig, length: int, activity: dict[str, ActivityState] | None = None, histories: dict[str, HistoryState] | None = None):
        self.config, self.length = config, length
        self._first = (activity or {}, histories or {})
        self.reset()

    def reset(self) -> None:
        self.activity, self.histories = copy.deepcopy(self._first)

    def clone(self) -> Session:
        return Session(self.config, self.length, copy.deepcopy(self.activity), copy.deepcopy(self.histories))

    def score(self, events: list[dict], *, commit: bool) -> list[dict]:
        """Each event has entity, t, key, cents and item; adds ``activity`` (counts and cents) and ``history``."""
        work, out = self.clone(), []
        for e in sorted(events, key=lambda e: (e["entity"], e["t"], e["key"])):
            activity = work.activity.setdefault(e["entity"], ActivityState(self.config.windows)).add(e["t"], e["cents"])
            if activity is None:
                raise ValueError("an event is earlier than the session's last one")
            history = work.histories.setdefault(e["entity"], HistoryState(self.length)).advance(e["t"], e["key"], e["item"])
            out.append(e | {"activity": activity, "history": history})
        if commit:
            self.activity, self.histories = work.activity, work.histories
        return out
