import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystream.operators.velocity import VelocityConfig, add_velocity
from tallystream.streaming.activity import ActivityState, state_snapshot
from tallystream.streaming.keyed import Activity, keyed_velocity, slot_seconds, stream_snapshot

CONFIG = VelocityConfig((50, 300), "who", "t", "amt")
SCHEMA = "id long, who string, t long, amt double"


class Slots:
    def __init__(self):
        self.slots, self.loads = {}, 0

    def load(self, n):
        self.loads += 1
        return self.slots.get(n)

    def activity(self, head, windows=(50, 300), width=10):
        return Activity(windows, width, head, self.load, lambda n, x: self.slots.__setitem__(n, tuple(list(v) for v in x)), lambda n: self.slots.pop(n, None))


@pytest.mark.parametrize("step", [1, 3, 40, 700])
def test_activity_equals_the_plain_one(step):
    draw, store, plain, head = np.random.default_rng(step), Slots(), ActivityState((50, 300)), None
    t = -400
    for _ in range(40):
        own = store.activity(head)
        for _ in range(int(draw.integers(1, 9))):
            t += int(draw.integers(0, step + 1))
            amount = int(draw.integers(1, 99))
            assert own.add(t, amount) == plain.add(t, amount)
        assert own.add(t - 1, 1) is None
        own.flush()
        head = own.head()
    assert all((n + 1) * 10 > t - 300 for n in store.slots) and set(store.slots) == set(head[8])


def test_an_event_reads_few_slots():
    store = Slots()
    own = store.activity(None, (3600, 86400), 2700)
    for t in range(0, 86400, 5):
        own.add(t, 1)
    own.flush()
    head, store.loads = own.head(), 0
    own = store.activity(head, (3600, 86400), 2700)
    assert own.add(86400, 1)[0] == 720 and store.loads <= 4  # of 17,280 buckets in 32 slots


def test_expiry_keeps_totals():
    store = Slots()
    own = store.activity(None)
    for t in (0, 10, 20):
        own.add(t, 100)
    own.expire(500)
    own.flush()
    assert store.slots == {} and own.add(499, 1) is None
    again = store.activity(own.head())
    assert again.add(600, 5) == [0, 0, 0, 0, 3, 300] and again.add(610, 5) == [1, 5, 1, 5, 4, 305]


def data(n=400):
    draw = np.random.default_rng(4)
    times = np.sort(draw.integers(-500, 2500, n))
    return [(i, None if i % 7 == 0 else f"c{i % 3}", int(t), float(a)) for i, (t, a) in enumerate(zip(times, draw.integers(1, 900, n) / 4, strict=True))]


def run(spark, folder, parts, **options):
    """Feed each part as a file of its own, one file a batch; returns the rows."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/p{i}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    stream = keyed_velocity(source, CONFIG, "id", **options)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()


def plain(rows):
    return sorted((r.id, r.who, *[r[c] for c in CONFIG.names()]) for r in rows)


def test_streams_go_on(spark, tmp_path):
    rows = data()
    want = {r.id: tuple(r[c] for c in CONFIG.names()) for r in add_velocity(spark.createDataFrame(rows, SCHEMA), CONFIG).collect()}
    first = [r for r in rows if r[2] < 300]
    cut = [r for r in rows if 300 <= r[2] < 900], [r for r in rows if 900 <= r[2]]
    snapshot = state_snapshot(spark.createDataFrame(first, SCHEMA), CONFIG)
    folder = f"file://{tmp_path}"
    got = run(spark, folder, cut, snapshot=snapshot, delay="1000 seconds")
    assert {r.key: tuple(r[c] for c in CONFIG.names()) for r in got} == {k: v for k, v in want.items() if k >= len(first)} and not any(r.late for r in got)
    # The states are read back: they are the snapshot of all rows.
    key = lambda r: (r.entity is None, r.entity)
    kept = sorted(stream_snapshot(spark, f"{folder}/state", CONFIG).collect(), key=key)
    assert kept == sorted(state_snapshot(spark.createDataFrame(rows, SCHEMA), CONFIG).collect(), key=key)


def test_silent_entities_and_late_rows(spark, tmp_path):
    parts = [[(0, "a", 100, 1.0), (7, "a", 110, 1.0), (1, "b", 100, 1.0)], [(2, "b", 5000, 1.0)], [(3, "b", 5001, 1.0), (4, "b", 4999, 1.0)], [(5, "a", 200, 1.0), (6, "a", 9000, 2.0)]]
    folder = f"file://{tmp_path}"
    got = {r.key: r for r in run(spark, folder, parts, on_late="mark", delay="10 seconds")}
    assert set(got) == set(range(8)) and {k for k, r in got.items() if r.late} == {4, 5}
    assert got[6].cc_txn_count_prior == 2 and got[3].cc_txn_count_prev_50s == 1
    states = {r.entity: r for r in stream_snapshot(spark, f"{folder}/state", CONFIG).collect()}
    assert states["a"].times == [] and states["a"].total_n == 2 and states["b"].total_n == 2
    with pytest.raises(ValueError):
        keyed_velocity(spark.createDataFrame([], SCHEMA), CONFIG, "id", on_late="drop")


def test_slots():
    assert slot_seconds(VelocityConfig((86400,))) == 2700 and slot_seconds(VelocityConfig((5,))) == 1
