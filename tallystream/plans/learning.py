"""Models and streams over the tables; SQL expresses the streams' results, not the models'."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators import averaging, models, neural
from tallystream.operators.sequences import add_history
from tallystream.operators.velocity import VelocityConfig
from tallystream.plans import activity, tables
from tallystream.sources.shared import new_path
from tallystream.streaming.activity import advanced_snapshot, load_snapshot, save_snapshot, state_snapshot, velocity_from_snapshot
from tallystream.streaming.histories import stream_histories
from tallystream.streaming.keyed import keyed_velocity, stream_snapshot

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a label that depends on two of the numbers and some noise."""
    noise = F.pmod(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), F.lit(100))
    label = (F.col("l_quantity") * 2 + F.col("l_discount") * 500 + noise > 175).cast("int")
    return tables.lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "t", *_FEATURES, label.alias("label"))


def _scored(spark: SparkSession, sf_dir: str, kind: str, params: dict) -> DataFrame:
    scale = {"l_quantity": 50.0, "l_extendedprice": 100000.0, "l_discount": 0.1, "l_tax": 0.08}
    rows = _lines(spark, sf_dir).select("*", *[(F.col(c) / scale[c]).alias(f"s_{c}") for c in _FEATURES])
    rows = VectorAssembler(inputCols=[f"s_{c}" for c in _FEATURES], outputCol="features").transform(rows)
    early = F.col("t") < F.unix_timestamp(F.lit("1999-01-01 00:00:00"))
    model = models.fit(kind, params, rows.filter(early))
    return models.score(model, rows.filter(~early)).select("l_orderkey", "l_linenumber", "label", F.round("p", 6).alias("p"))


def lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "logistic", {"C": 1.0, "max_iter": 50})


def rf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "forest", {"trees": 10, "depth": 5, "leaf": 1})


def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "boosted", {"rounds": 5, "depth": 3, "rate": 0.1})


_SCALE = np.array([50.0, 100000.0, 0.1, 0.08])


def mlp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed-forward scorer trained on all early line items, stopped by those after them, and applied to all."""
    rows = _lines(spark, sf_dir).withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    scaled = rows.select("l_orderkey", "l_linenumber", "label", "key", "t", *[(F.col(c) / float(s)).alias(c) for c, s in zip(_FEATURES, _SCALE, strict=True)])
    config = neural.TrainConfig(hidden=(16,), epochs=4)
    fitted = averaging.train_on_all(lambda: neural.FeedForward(len(_FEATURES), config), *_by_time(scaled), config, inputs=_FEATURES)
    return neural.score_rows(scaled.drop("key", "t"), fitted.model, _FEATURES, "p").select("l_orderkey", "l_linenumber", "label", F.round("p", 6).alias("p"))


def lstm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recurrent scorer of each order's history, trained on all early orders, stopped by those after them, and applied to all."""
    rows = tables.orders(spark, sf_dir).withColumn("item", F.array(F.col("o_totalprice") / 5e5, (F.col("t") % 31) / 31.0)).withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    histories = add_history(rows, 6, entity="o_custkey", time="t", key="o_orderpriority", row="o_orderkey", value="item").select("o_orderkey", "label", "t", "history")
    config = neural.TrainConfig(hidden=(8, 8), epochs=2)
    keyed = histories.withColumn("key", F.col("o_orderkey").cast("string"))
    fitted = averaging.train_on_all(lambda: neural.Recurrent(2, config), *_by_time(keyed), config, inputs=["history"], length=6)
    return neural.score_histories(histories.drop("t"), fitted.model, "history", 6, "p").select("o_orderkey", "label", F.round("p", 6).alias("p"))


def _by_time(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows before the last fifth of the time span, and those in it."""
    first, last = rows.agg(F.min("t"), F.max("t")).first()
    at = first + (last - first) * 4 // 5
    return rows.filter(F.col("t") < at), rows.filter(F.col("t") >= at)


def _drained(stream: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run a stream over what is there, into a table in the shared folder."""
    folder = new_path(spark, "stream")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = tables.table(spark, sf_dir, "events").schema
    name = f"{sf_dir}/events.parquet"
    # A folder of files is a stream's source; a single file is found by a pattern.
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(name if _is_folder(spark, name) else f"{sf_dir}/event[s].parquet")
    return source.select("event_id", "user_id", "value", tables.timestamp_seconds(F.col("ts")).alias("t"), F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")).alias("micros"))


def _is_folder(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


_CONFIG = VelocityConfig(activity.EVENTS, "user_id", "t", "value")


def stream_velocity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity of all events as a stream on keyed states: equal to the batch result."""
    out = _drained(keyed_velocity(_stream(spark, sf_dir), _CONFIG, "event_id"), spark, sf_dir)
    return out.select(F.col("key").alias("event_id"), F.col("entity").alias("user_id"), "t", *_CONFIG.names())


def stream_from_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late events as a stream that starts from the saved state of the early ones."""
    rows = tables.events(spark, sf_dir)
    (at,) = tables.times_at(rows, (0.7,))
    path = new_path(spark, "activity-state")
    save_snapshot(state_snapshot(rows.filter(F.col("t") < at), _CONFIG), _CONFIG, path)
    late = _stream(spark, sf_dir).filter(F.col("t") >= at)
    out = _drained(keyed_velocity(late, _CONFIG, "event_id", snapshot=load_snapshot(spark, path, _CONFIG)), spark, sf_dir)
    return out.select(F.col("key").alias("event_id"), F.col("entity").alias("user_id"), "t", *_CONFIG.names())


def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of a stream of all events, read from its checkpoint."""
    folder = new_path(spark, "stream")
    stream = keyed_velocity(_stream(spark, sf_dir), _CONFIG, "event_id", delay="3650 days")
    query = stream.writeStream.format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream_snapshot(spark, folder, _CONFIG).select("entity", "open", "open_n", "open_cents", "total_n", "total_cents", F.size("times").cast("long").alias("buckets"))


def stream_histories_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four event values of every user, as a stream: rows, not seconds, in the order of their full time."""
    out = _drained(stream_histories(_stream(spark, sf_dir), 4, entity="user_id", time="micros", key="event_id", item="value", shared=False), spark, sf_dir)
    values = F.filter("history", lambda x: x.isNotNull())
    total = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x))
    return out.select(F.col("key").cast("long").alias("event_id"), F.size("history").cast("long").alias("length"), F.round(total, 6).alias("total"))


def some_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which some have no user."""
    return tables.events(spark, sf_dir).withColumn("user_id", F.when(F.col("user_id") % 13 > 0, F.col("user_id")))


def continued_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late events go on from the state that the early ones left."""
    rows = some_unknown(spark, sf_dir)
    (at,) = tables.times_at(rows, (0.7,))
    snapshot = state_snapshot(rows.filter(F.col("t") < at), _CONFIG)
    return velocity_from_snapshot(rows.filter(F.col("t") >= at), snapshot, _CONFIG).select("event_id", "user_id", "t", *_CONFIG.names())


def advanced_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all events, reached by two steps from the state after the first part."""
    rows = some_unknown(spark, sf_dir)
    first, second = tables.times_at(rows, (0.4, 0.8))
    state = state_snapshot(rows.filter(F.col("t") < first), _CONFIG)
    state = advanced_snapshot(state, rows.filter((F.col("t") >= first) & (F.col("t") < second)), _CONFIG)
    state = advanced_snapshot(state, rows.filter(F.col("t") >= second), _CONFIG)
    return state.select("entity", "open", "open_n", "open_cents", "total_n", "total_cents", F.size("times").cast("long").alias("buckets"))


def _states_sql(source: str) -> str:
    return f"""WITH b AS (SELECT user_id, t, count(*) AS n, CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS BIGINT) AS c FROM {source} GROUP BY ALL),
      l AS (SELECT user_id, max(t) AS open, arg_max(n, t) AS open_n, arg_max(c, t) AS open_cents, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS c FROM b GROUP BY 1)
      SELECT l.user_id AS entity, open, open_n, open_cents, l.n - open_n AS total_n, l.c - open_cents AS total_cents, (SELECT count(*) FROM b WHERE b.user_id IS NOT DISTINCT FROM l.user_id AND b.t < open AND b.t >= open - 86400) AS buckets FROM l"""


_SOME = f"(SELECT * REPLACE (CASE WHEN user_id % 13 > 0 THEN user_id END AS user_id) FROM {tables.EVENTS})"
QUERIES = {f.__name__: f for f in (lr_scores, rf_scores, gbt_scores, mlp_scores, lstm_scores, stream_velocity_events, stream_from_state, stream_states, stream_histories_events, continued_velocity, advanced_state)}
SQL = {
    "stream_velocity_events": activity.SQL["velocity_events"],
    "stream_histories_events": f"SELECT event_id, count(*) OVER w AS length, round(sum(value) OVER w, 6) AS total FROM {tables.EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "stream_from_state": f"SELECT * FROM ({activity.SQL['velocity_events']}) WHERE t >= (SELECT quantile_cont(t, 0.7) FROM {tables.EVENTS})",
    "stream_states": _states_sql(tables.EVENTS),
    "advanced_state": _states_sql(_SOME),
    "continued_velocity": f"SELECT * FROM ({activity._sql(_SOME, 'user_id', 'value', 'event_id, user_id, t', activity.EVENTS)}) WHERE t >= (SELECT quantile_cont(t, 0.7) FROM {tables.EVENTS})",
}
