"""Batches scored one after another against states in versions: a batch takes effect as a whole, or, as a preview, not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.sources.shared import drop_table, written
from tallystream.streaming.activity import velocity_from_snapshot
from tallystream.streaming.entities import ACTIVITY, EntitySpec, advanced_states, with_history
from tallystream.streaming.store import StateStore

#: Prepared rows with activity to rows with the item column; rows with their histories to scored rows, all rows kept.
Step = Callable[[DataFrame], DataFrame]


class BatchSession:
    """Goes on from the version of ``store``; ``reset`` returns to it.

    ``prepare`` adds the item column to rows with activity; ``score`` gets these with ``history``, ``context_depth`` and ``seeded``
    and adds what is scored, keeping ``unique``, the column that no two rows of a session may share.
    """

    def __init__(self, store: StateStore, spec: EntitySpec, *, prepare: Step, score: Step, unique: str):
        self.first = self.store = store
        self.spec, self._prepare, self._score, self.unique = spec, prepare, score, unique

    def reset(self) -> None:
        self.store = self.first

    @property
    def rows(self) -> int:
        """Rows that were committed in this session."""
        return self.store.at.rows - self.first.at.rows

    def score(self, batch: DataFrame, *, commit: bool = True) -> DataFrame:
        """The scored rows of a batch. Where anything fails, or another session has committed meanwhile (``FileExistsError``), the
        session is as it was before."""
        entity = F.col(self.spec.config.entity).alias("entity")
        states = written(self.store.lookup(batch.select(entity)), "own-states")
        rows = self._prepare(velocity_from_snapshot(batch, states.select("entity", *ACTIVITY), self.spec.config))
        rows = written(rows, "prepared")
        rows_with = with_history(rows, states, self.spec).withColumn("context_depth", F.size("history"))
        scored = written(self._score(rows_with), "scored")
        found = scored.agg(F.count("*").alias("n"), F.count_distinct(self.unique).alias("u")).first()
        if found["n"] != rows.count() or found["u"] != found["n"]:
            raise ValueError("scoring must keep every row, and its ids must not repeat")
        before = self.store.results()
        if before is not None and before.select(self.unique).join(scored.select(self.unique), self.unique, "left_semi").limit(1).count():
            raise ValueError("a row was scored before in this session")
        if commit:
            self.store = self.store.commit(advanced_states(states, rows, self.spec), scored)
        for table in (states, rows):
            drop_table(table)
        return scored

    def result(self, ids: list) -> DataFrame:
        """The committed rows with these ids; each must be there once."""
        from tallystream.operators.fusion import by_id

        found = self.store.results()
        if found is None:
            raise KeyError("nothing was scored")
        return by_id(found, ids, self.unique)
