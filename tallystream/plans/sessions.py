"""Batches that are scored against states in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators.velocity import VelocityConfig
from tallystream.plans import activity, tables
from tallystream.sources.shared import new_path
from tallystream.streaming.batches import BatchSession
from tallystream.streaming.entities import EntitySpec, entity_states
from tallystream.streaming.store import StateStore

SPEC = EntitySpec(VelocityConfig(activity.EVENTS, "who", "t", "value"), 4, "event_id", "value")
#: Shares of the events that are known at first, and before each further batch.
SHARES = (0.4, 0.6, 0.8)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which some have no user."""
    return tables.events(spark, sf_dir).select("event_id", F.when(F.col("user_id") % 13 > 0, F.col("user_id")).alias("who"), "t", "value")


def _scored(rows: DataFrame) -> DataFrame:
    mean = F.aggregate("history", F.lit(0.0), lambda a, x: a + x) / F.col("context_depth")
    margin = 0.3 * F.col("cc_txn_count_prev_24h") - 0.001 * F.col("cc_amt_sum_prior") + 0.01 * mean
    return rows.select("event_id", *SPEC.config.names(), "context_depth", F.round(mean, 6).alias("mean"), "seeded", F.round(1 / (1 + F.exp(-margin)), 6).alias("p"))


def session_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of events scored one after another from the state that earlier events left; the second one is a preview
    first, of which every row is compared with what was committed. Committed rows are read back from the store."""
    rows = _events(spark, sf_dir)
    cuts = tables.times_at(rows, SHARES)
    store = StateStore.create(spark, new_path(spark, "sessions"), entity_states(rows.filter(F.col("t") < cuts[0]), SPEC), buckets=16)
    session = BatchSession(store, SPEC, prepare=lambda df: df, score=_scored, unique="event_id")
    preview = None
    for i, start in enumerate(cuts):
        batch = rows.filter((F.col("t") >= start) & (F.col("t") < cuts[i + 1] if i + 1 < len(cuts) else F.lit(True)))
        if i == 1:
            preview = session.score(batch, commit=False)
        session.score(batch)
    same = preview.select(F.col("event_id").alias("seen"), F.xxhash64(*preview.columns).alias("h"))
    out = session.store.results().join(same, F.col("event_id") == F.col("seen"), "left")
    return out.select(*preview.columns, F.coalesce(F.col("h") == F.xxhash64(*preview.columns), F.lit(False)).alias("previewed"))


def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that the batches leave, after a new base was written of the store's deltas."""
    rows = _events(spark, sf_dir)
    cuts = tables.times_at(rows, SHARES)
    store = StateStore.create(spark, new_path(spark, "sessions"), entity_states(rows.filter(F.col("t") < cuts[0]), SPEC), buckets=16)
    session = BatchSession(store, SPEC, prepare=lambda df: df, score=_scored, unique="event_id")
    session.score(rows.filter((F.col("t") >= cuts[0]) & (F.col("t") < cuts[2])))
    session.score(rows.filter(F.col("t") >= cuts[2]))
    kept = StateStore.open(spark, store.folder).compacted().states()
    past = F.array_join(F.transform("past", lambda p: F.rint(p["item"] * 100).cast("long").cast("string")), ",")
    return kept.select("entity", "open", "open_n", "open_cents", "total_n", "total_cents", F.size("times").cast("long").alias("buckets"), past.alias("past"), "seeded")


QUERIES = {f.__name__: f for f in (session_batches, session_states)}

_WHO = f"(SELECT event_id, CASE WHEN user_id % 13 > 0 THEN user_id END AS who, t, value FROM {tables.EVENTS})"
_ITEMS = f"(SELECT who, t, arg_min(value, CAST(event_id AS VARCHAR)) AS item FROM {_WHO} GROUP BY ALL)"
_CUTS = f"(SELECT quantile_cont(t, {SHARES[0]}) AS a, quantile_cont(t, {SHARES[1]}) AS b, quantile_cont(t, {SHARES[2]}) AS c FROM {_WHO})"
SQL = {
    "session_batches": f"""WITH v AS ({activity._sql(_WHO, "who", "value", "event_id, who, t, value", activity.EVENTS)}),
      h AS (SELECT who, t, list(item) OVER (PARTITION BY who ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS past FROM {_ITEMS}),
      f AS (SELECT v.*, list_concat(coalesce(h.past, []), [v.value]) AS history, v.who IN (SELECT who FROM v WHERE t < (SELECT a FROM {_CUTS})) OR (v.who IS NULL AND EXISTS (SELECT 1 FROM v WHERE who IS NULL AND t < (SELECT a FROM {_CUTS}))) AS seeded
            FROM v JOIN h ON v.who IS NOT DISTINCT FROM h.who AND v.t = h.t),
      m AS (SELECT *, list_sum(history) / len(history) AS mean_value FROM f)
      SELECT event_id, {", ".join(SPEC.config.names())}, CAST(len(history) AS INTEGER) AS context_depth, round(mean_value, 6) AS mean, coalesce(seeded, false) AS seeded,
        round(1 / (1 + exp(-(0.3 * cc_txn_count_prev_24h - 0.001 * cc_amt_sum_prior + 0.01 * mean_value))), 6) AS p, t >= b AND t < c AS previewed FROM m, {_CUTS} WHERE t >= a""",
    "session_states": f"""WITH b AS (SELECT who, t, count(*) AS n, CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS BIGINT) AS c FROM {_WHO} GROUP BY ALL),
      l AS (SELECT who, max(t) AS open, arg_max(n, t) AS open_n, arg_max(c, t) AS open_cents, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS c, min(t) < (SELECT a FROM {_CUTS}) AS seeded FROM b GROUP BY 1),
      i AS (SELECT who, string_agg(CAST(CAST(round_even(item * 100, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS past FROM (SELECT * FROM {_ITEMS} QUALIFY row_number() OVER (PARTITION BY who ORDER BY t DESC) <= 4) GROUP BY 1)
      SELECT l.who AS entity, open, open_n, open_cents, l.n - open_n AS total_n, l.c - open_cents AS total_cents, (SELECT count(*) FROM b WHERE b.who IS NOT DISTINCT FROM l.who AND b.t < open AND b.t >= open - 86400) AS buckets, i.past, seeded
      FROM l JOIN i ON l.who IS NOT DISTINCT FROM i.who""",
}
