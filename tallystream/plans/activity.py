"""Rolling and lifetime activity, pointers and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators import sequences
from tallystream.operators.prepared import Places, ensure_streams, register_sources
from tallystream.operators.velocity import VelocityConfig, add_velocity, measured_plan, window_label
from tallystream.plans import tables
from tallystream.sources.shared import new_path

DAY = 86400
EVENTS, ORDERS, LINES = (3600, 21600, 86400), (30 * DAY, 90 * DAY, 365 * DAY), (7 * DAY, 30 * DAY)
CUSTOM = (90, 5400, 172800)


def velocity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of every user in the last hour, six hours, day and before."""
    config = VelocityConfig(EVENTS, "user_id", "t", "value")
    return add_velocity(tables.events(spark, sf_dir), config).select("event_id", "user_id", "t", *config.names())


def velocity_events_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by running totals with expiry."""
    config = VelocityConfig(EVENTS, "user_id", "t", "value")
    return add_velocity(tables.events(spark, sf_dir), config, heavy=True).select("event_id", "user_id", "t", *config.names())


def velocity_events_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every user's time in chunks of four days."""
    config = VelocityConfig(EVENTS, "user_id", "t", "value")
    return add_velocity(tables.events(spark, sf_dir), config, chunk=4 * DAY).select("event_id", "user_id", "t", *config.names())


def velocity_orders_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tied orders, with customers' time in chunks of a leap year, by running totals with expiry."""
    config = VelocityConfig(ORDERS, "o_custkey", "t", "o_totalprice")
    return add_velocity(tables.orders(spark, sf_dir), config, heavy=True, chunk=366 * DAY).select("o_orderkey", "o_custkey", "t", *config.names())


def velocity_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of suppliers by the plan that the table's own counts ask for; here running totals, and time in chunks."""
    rows, config = tables.lineitem(spark, sf_dir), VelocityConfig(LINES, "l_suppkey", "t", "l_extendedprice")
    out = add_velocity(rows, config, **measured_plan(rows, config, heavy_rows=8, task_rows=500))
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "t", *config.names())


#: 1996-01-01.
_LATE = 820_454_400


def ensured_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature streams of the orders before and from 1996, registered, made, and found again by a second call."""
    places, config = Places.below(new_path(spark, "streams")), VelocityConfig(ORDERS, "o_custkey", "t", "o_totalprice")
    rows = tables.orders(spark, sf_dir).select("o_orderkey", "o_custkey", "t", "o_totalprice")
    rows.filter(F.col("t") < _LATE).write.parquet(places.development)
    rows.filter(F.col("t") >= _LATE).write.parquet(places.holdout)
    register_sources(spark, places)
    for _ in range(2):
        found = ensure_streams(spark, places, config, prepare=lambda x: x)
    return found["development"].unionByName(found["holdout"]).select("o_orderkey", "o_custkey", "t", *config.names())


def velocity_orders_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = VelocityConfig(ORDERS, "o_custkey", "t", "o_totalprice")
    return add_velocity(tables.orders(spark, sf_dir), config).select("o_orderkey", "o_custkey", "t", *config.names())


def velocity_lineitem_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many rows share a day: all of them see the same past."""
    config = VelocityConfig(LINES, "l_suppkey", "t", "l_extendedprice")
    out = add_velocity(tables.lineitem(spark, sf_dir), config, heavy=True)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "t", *config.names())


def custom_windows_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = VelocityConfig(CUSTOM, "user_id", "t", "value")
    return add_velocity(tables.events(spark, sf_dir), config).select("event_id", *config.names())


def prior_totals_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = VelocityConfig(ORDERS[:1], "o_custkey", "t", "o_totalprice")
    return add_velocity(tables.orders(spark, sf_dir), config).select("o_orderkey", "cc_txn_count_prior", "cc_amt_sum_prior")


_ORDER = {"entity": "o_custkey", "time": "t", "key": "o_orderpriority", "row": "o_orderkey"}


def pointer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The previous order of each order's customer."""
    return sequences.add_pointer(tables.orders(spark, sf_dir), **_ORDER).select("o_orderkey", "o_custkey", "previous")


def sequence_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twelve orders of each order's customer, oldest first, as text."""
    out = sequences.add_history(tables.orders(spark, sf_dir), 12, **_ORDER)
    return out.select("o_orderkey", F.size("history").cast("long").alias("length"), F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"))


def sequence_values_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices of the last four orders, filled up with zeros."""
    out = sequences.add_history(tables.orders(spark, sf_dir), 4, **_ORDER, value="o_totalprice")
    padded = sequences.pad_history(F.col("history"), 4, F.lit(0.0))
    return out.select("o_orderkey", *[padded[i].alias(f"v{i}") for i in range(4)])


def sequence_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories where some orders have no customer, which are one entity, and some no price, which stay in the history."""
    rows = tables.orders(spark, sf_dir).withColumn("who", F.when(F.col("o_custkey") % 9 > 0, F.col("o_custkey"))).withColumn("price", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice")))
    out = sequences.add_history(rows, 5, **(_ORDER | {"entity": "who"}), value="price")
    return out.select("o_orderkey", F.size("history").cast("long").alias("length"), F.array_join(F.transform("history", lambda x: F.coalesce(F.rint(x * 100).cast("long").cast("string"), F.lit("-"))), ",").alias("history"))


def latest_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.latest_per_entity(tables.orders(spark, sf_dir), **_ORDER).select("o_custkey", "o_orderkey", "t")


def cold_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a predecessor, by year."""
    out = sequences.add_pointer(tables.orders(spark, sf_dir), **_ORDER)
    return out.groupBy(F.year("o_orderdate").alias("year")).agg(F.count_if(F.col("previous") == -1).alias("cold"), F.count("*").alias("rows"))


def _sql(source: str, entity: str, amount: str, columns: str, windows: tuple[int, ...]) -> str:
    parts = []
    for w in [*windows, None]:
        frame = f"OVER (PARTITION BY {entity} ORDER BY t RANGE BETWEEN {'UNBOUNDED' if w is None else w} PRECEDING AND 1 PRECEDING)"
        span = "prior" if w is None else f"prev_{window_label(w)}"
        parts += [f"count(t) {frame} AS cc_txn_count_{span}", f"coalesce(sum(CAST(round_even({amount} * 100, 0) AS BIGINT)) {frame}, 0) / 100.0 AS cc_amt_sum_{span}"]
    return f"SELECT {columns}, {', '.join(parts)} FROM {source}"


_REP = f"(SELECT *, first_value(o_orderkey) OVER (PARTITION BY o_custkey, t ORDER BY o_orderpriority, o_orderkey) AS rep FROM {tables.ORDERS})"
_POINTER = f"(SELECT *, coalesce(last_value(rep) OVER (PARTITION BY o_custkey ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS previous FROM {_REP})"
_BUCKETS = f"(SELECT o_custkey, t, arg_min(struct_pack(k := o_orderkey, v := o_totalprice), (o_orderpriority, o_orderkey)) AS item FROM {tables.ORDERS} GROUP BY ALL)"


def _history(length: int) -> str:
    return f"""(SELECT o.o_orderkey, o.o_totalprice, list_concat(coalesce(b.past, []), [struct_pack(k := o.o_orderkey, v := o.o_totalprice)]) AS h
      FROM {tables.ORDERS} o JOIN (SELECT o_custkey, t, list(item) OVER (PARTITION BY o_custkey ORDER BY t ROWS BETWEEN {length - 1} PRECEDING AND 1 PRECEDING) AS past FROM {_BUCKETS}) b USING (o_custkey, t))"""


_NULLS = f"""WITH o AS (SELECT *, CASE WHEN o_custkey % 9 > 0 THEN o_custkey END AS who, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS price FROM {tables.ORDERS}),
b AS (SELECT who, t, arg_min(struct_pack(v := price), (o_orderpriority, o_orderkey)) AS item FROM o GROUP BY ALL),
w AS (SELECT who, t, list(item) OVER (PARTITION BY who ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS past FROM b),
h AS (SELECT o.o_orderkey, list_concat(coalesce(w.past, []), [struct_pack(v := o.price)]) AS h FROM o JOIN w ON o.who IS NOT DISTINCT FROM w.who AND o.t = w.t)
SELECT o_orderkey, CAST(len(h) AS BIGINT) AS length, array_to_string(list_transform(h, lambda x: coalesce(CAST(CAST(round_even(x.v * 100, 0) AS BIGINT) AS VARCHAR), '-')), ',') AS history FROM h"""


QUERIES = {
    f.__name__: f
    for f in (
        velocity_measured, ensured_streams, velocity_events, velocity_events_heavy, velocity_events_chunked, velocity_orders_chunked, sequence_nulls, velocity_orders_ties, velocity_lineitem_ties, custom_windows_events, prior_totals_orders,
        pointer_orders, sequence_orders, sequence_values_padded, latest_per_entity, cold_starts,
    )
}
_EVENTS_SQL = _sql(tables.EVENTS, "user_id", "value", "event_id, user_id, t", EVENTS)
SQL = {
    "velocity_measured": _sql(tables.LINEITEM, "l_suppkey", "l_extendedprice", "l_orderkey, l_linenumber, l_suppkey, t", LINES),
    "ensured_streams": _sql(tables.ORDERS, "o_custkey", "o_totalprice", "o_orderkey, o_custkey, t", ORDERS),
    "velocity_events": _EVENTS_SQL,
    "velocity_events_heavy": _EVENTS_SQL,
    "velocity_events_chunked": _EVENTS_SQL,
    "velocity_orders_chunked": _sql(tables.ORDERS, "o_custkey", "o_totalprice", "o_orderkey, o_custkey, t", ORDERS),
    "sequence_nulls": _NULLS,
    "velocity_orders_ties": _sql(tables.ORDERS, "o_custkey", "o_totalprice", "o_orderkey, o_custkey, t", ORDERS),
    "velocity_lineitem_ties": _sql(tables.LINEITEM, "l_suppkey", "l_extendedprice", "l_orderkey, l_linenumber, l_suppkey, t", LINES),
    "custom_windows_events": "SELECT * EXCLUDE (user_id, t) FROM (" + _sql(tables.EVENTS, "user_id", "value", "event_id, user_id, t", CUSTOM) + ")",
    "prior_totals_orders": "SELECT o_orderkey, cc_txn_count_prior, cc_amt_sum_prior FROM (" + _sql(tables.ORDERS, "o_custkey", "o_totalprice", "o_orderkey", ORDERS[:1]) + ")",
    "pointer_orders": f"SELECT o_orderkey, o_custkey, previous FROM {_POINTER}",
    "sequence_orders": f"SELECT o_orderkey, len(h) AS length, array_to_string(list_transform(h, lambda x: CAST(x.k AS VARCHAR)), ',') AS history FROM {_history(12)}",
    "sequence_values_padded": "SELECT o_orderkey, " + ", ".join(f"coalesce(h[{i + 1}].v, 0.0) AS v{i}" for i in range(4)) + f" FROM {_history(4)}",
    "latest_per_entity": f"SELECT o_custkey, o_orderkey, t FROM {tables.ORDERS} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY t DESC, o_orderpriority, o_orderkey) = 1",
    "cold_starts": f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) FILTER (WHERE previous = -1) AS BIGINT) AS cold, count(*) AS rows FROM {_POINTER} GROUP BY ALL",
}
