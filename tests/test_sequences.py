import pytest
from pyspark.sql import functions as F

from tallystream.operators.sequences import add_history, add_pointer, check_pointers, latest_per_entity, pad_history
from tallystream.operators.velocity import VelocityConfig
from tallystream.streaming.activity import ActivityState, state_snapshot, velocity_from_snapshot
from tallystream.streaming.histories import HistoryState, Session, history_context

ROWS = [("a", 10, "z"), ("a", 10, "a"), ("b", 10, "b"), ("a", 11, "c"), ("b", 11, "d"), ("a", 11, "e")]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "row_idx long, cc_num string, unix_time long, trans_num string")


def test_pointers(rows):
    out = add_pointer(rows)
    assert [r["previous"] for r in out.orderBy("row_idx").collect()] == [-1, -1, -1, 1, 2, 1]
    assert check_pointers(out) == 3
    with pytest.raises(ValueError):
        check_pointers(out.withColumn("previous", F.col("row_idx")))


def test_histories(rows):
    got = {r["row_idx"]: r["history"] for r in add_history(rows, 4).collect()}
    assert got == {0: [0], 1: [1], 2: [2], 3: [1, 3], 4: [2, 4], 5: [1, 5]}
    assert {r["row_idx"]: r["history"] for r in add_history(rows, 1).collect()}[5] == [5]
    padded = add_history(rows, 4).select(pad_history(F.col("history"), 4, F.lit(-1).cast("long")).alias("h"), "row_idx").filter("row_idx = 3").first()
    assert padded.h == [1, 3, -1, -1]
    with pytest.raises(ValueError):
        add_history(rows, 0)


def test_latest(rows):
    assert {r["cc_num"]: r["row_idx"] for r in latest_per_entity(rows).collect()} == {"a": 3, "b": 4}


def test_online_history():
    state = HistoryState(12, [[1, 0]], 10, "z", [2, 0])
    out = [state.advance(t, k, v) for t, k, v in ((10, "b", [3, 0]), (10, "a", [4, 0]), (11, "c", [5, 0]))]
    assert [len(h) for h in out] == [2, 2, 3] and [h[-1] for h in out] == [[3, 0], [4, 0], [5, 0]] and out[2][1] == [4, 0]
    with pytest.raises(ValueError):
        state.advance(9, "x", [])


def test_activity_state_does_not_depend_on_batches():
    events = [(100, 10), (100, 20), (200, 100), (3700, 5), (3701, 1)]
    whole, parts = ActivityState((3600,)), ActivityState((3600,))
    expected = [whole.add(*e) for e in events]
    got = []
    for e in events:
        parts = ActivityState((3600,), parts.saved())
        got.append(parts.add(*e))
    assert got == expected and expected[3] == [3, 130, 3, 130] and expected[4] == [2, 105, 4, 135]
    assert parts.add(1, 1) is None


def test_session_preview_and_commit():
    session = Session(VelocityConfig(), 3)
    event = {"entity": "a", "t": 5, "key": "k", "cents": 100, "item": 1}
    session.score([event], commit=False)
    assert session.score([event | {"t": 6, "key": "l"}], commit=True)[0]["history"] == [1]
    later = session.score([event | {"t": 7, "item": 2}], commit=True)[0]
    assert later["history"] == [1, 2] and later["activity"][-2:] == [1, 100]
    with pytest.raises(ValueError):
        session.score([event], commit=True)
    session.reset()
    assert session.score([event], commit=False)[0]["history"] == [1]


def test_context(spark, rows):
    out = {r["entity"]: r for r in history_context(rows.withColumn("v", F.col("row_idx") * 10), 3, entity="cc_num", time="unix_time", key="trans_num", row="row_idx", item="v").collect()}
    assert (out["a"]["items"], out["a"]["open"], out["a"]["key"], out["a"]["item"]) == ([10], 11, "c", 30)


def test_snapshot_continues(spark):
    config = VelocityConfig()
    data = [("A", 100, 1.0, 0), ("A", 200, 2.0, 1), ("A", 200, 4.0, 2), ("A", 300, 3.0, 3), ("B", 300, 9.0, 4)]
    rows = spark.createDataFrame(data, "cc_num string, unix_time long, amt double, i int")
    got = {r["i"]: r for r in velocity_from_snapshot(rows.filter("i >= 2"), state_snapshot(rows.filter("i < 2"), config), config).collect()}
    assert (got[2]["cc_txn_count_prev_1h"], got[2]["cc_amt_sum_prior"]) == (1, 1.0)
    assert (got[3]["cc_txn_count_prior"], got[3]["cc_amt_sum_prev_1h"]) == (3, 7.0)
    assert got[4]["cc_txn_count_prior"] == 0
    with pytest.raises(ValueError):
        velocity_from_snapshot(rows.filter("i = 0"), state_snapshot(rows.filter("i = 3"), config), config)


def test_streamed_histories_keep_null_items(spark, tmp_path):
    from tallystream.plans import learning
    from tallystream.streaming.histories import stream_histories

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    values = [None, 1.5, None, None, None, None, 2.0]
    for i, part in enumerate((range(3), range(3, 7))):
        made = spark.createDataFrame([(e, 0, values[e]) for e in part], "event_id long, user_id long, value double")
        made.select("event_id", F.timestamp_micros(F.col("event_id") * 1_000_000).cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", F.lit("{}").alias("props")).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withColumn("t", F.unix_timestamp("ts"))
    stream = stream_histories(source, 4, entity="user_id", time="t", key="event_id", item="value", shared=False)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {int(r.key): r.history for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()}
    assert got == {e: values[max(0, e - 3) : e + 1] for e in range(7)}
    spark.read.schema(schema).parquet(f"{tmp_path}/in/*").write.parquet(f"{tmp_path}/events.parquet")
    rows = {r.event_id: (r.length, r.total) for r in learning.stream_histories_events(spark, str(tmp_path)).collect()}
    assert rows == {0: (1, None), 1: (2, 1.5), 2: (3, 1.5), 3: (4, 1.5), 4: (4, 1.5), 5: (4, None), 6: (4, 2.0)}
