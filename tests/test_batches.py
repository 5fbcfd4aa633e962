import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystream.operators.velocity import VelocityConfig, add_velocity
from tallystream.sources import files
from tallystream.streaming.batches import BatchSession
from tallystream.streaming.entities import EntitySpec, advanced_states, entity_states, with_history
from tallystream.streaming.store import StateStore

SPEC = EntitySpec(VelocityConfig((50, 300), "who", "t", "amt"), 3, "k", "v")
SCHEMA = "k string, who string, t long, amt double, v int"


def rows(spark, n=300):
    draw = np.random.default_rng(6)
    out = [(f"k{i:04d}", None if i % 6 == 0 else f"c{i % 4}", int(t), float(a), i if i % 9 else None) for i, (t, a) in enumerate(zip(draw.integers(-300, 600, n), draw.integers(1, 900, n) / 4, strict=True))]
    return spark.createDataFrame(out, SCHEMA)


def session(store):
    return BatchSession(store, SPEC, prepare=lambda d: d, score=lambda d: d.select("k", "t", *SPEC.config.names(), "history", "seeded", "context_depth"), unique="k")


def slow_histories(data):
    out = {}
    for r in data:
        seconds = {}
        for x in data:
            if x.who == r.who and x.t < r.t:
                seconds[x.t] = min(seconds.get(x.t, (x.k, x.v)), (x.k, x.v), key=lambda p: p[0])
        out[r.k] = [seconds[t][1] for t in sorted(seconds)[-2:]] + [r.v]
    return out


def test_batches_preview_and_commit(spark, tmp_path):
    data, folder = rows(spark), f"file://{tmp_path}/s"
    want = {r.k: tuple(r) for r in add_velocity(data, SPEC.config).select("k", *SPEC.config.names()).collect()}
    histories = slow_histories(data.collect())
    store = StateStore.create(spark, folder, entity_states(data.filter("t < 0 and coalesce(who, '') <> 'c3'"), SPEC), buckets=4)
    data_ = data.filter("t >= 0 or who = 'c3'")
    own, other = session(store), session(StateStore.open(spark, folder))
    for low, high in ((-999, 100), (100, 350), (350, 999)):
        batch = data_.filter(f"t >= {low} and t < {high}")
        preview = own.score(batch, commit=False).collect()
        committed = own.score(batch)
        assert sorted(preview) == sorted(committed.collect())
        for r in preview:
            assert (r.k, *[r[c] for c in SPEC.config.names()]) == want[r.k] and list(r.history) == histories[r.k] and r.context_depth == len(r.history)
        assert {r.k for r in preview if not r.seeded} == {r.k for r in batch.filter("who = 'c3'").collect()}
    assert own.rows == own.store.results().count() == data_.count() and own.store.at.number == 3
    key = lambda r: (r.entity is None, r.entity)
    kept = sorted(StateStore.open(spark, folder).states().drop("seeded").collect(), key=key)
    assert kept == sorted(entity_states(data, SPEC).drop("seeded").collect(), key=key)
    assert sorted(own.store.compacted().states().drop("seeded").collect(), key=key) == kept
    ids = [r.k for r in committed.limit(2).collect()]
    assert own.result(ids).count() == 2
    with pytest.raises(KeyError):
        own.result(["none"])
    # Another session that started from the first version has lost the race, and stays as it was.
    with pytest.raises(FileExistsError):
        other.score(data_.filter("t < 100"))
    assert other.store.at.number == 0 and other.score(data_.filter("t < 100"), commit=False).count() == data_.filter("t < 100").count()
    own.reset()
    assert own.rows == 0 and own.store.results() is None


def test_what_fails_changes_nothing(spark, tmp_path):
    data, folder = rows(spark, 60), f"file://{tmp_path}/s"
    store = StateStore.create(spark, folder, entity_states(data.filter("t < 100"), SPEC))
    own = session(store)
    late = data.filter("t >= 300")
    own.score(data.filter("t >= 100 and t < 300"))
    with pytest.raises(ValueError, match="earlier"):
        own.score(data.filter("t < 0").withColumn("k", F.concat("k", F.lit("x"))))
    with pytest.raises(ValueError, match="before"):
        own.score(late.withColumn("k", F.lit("k0001")).limit(1).unionByName(data.filter("t >= 100 and t < 300").limit(1).withColumn("t", F.lit(999).cast("long"))))
    with pytest.raises(ValueError, match="repeat"):
        own.score(late.unionByName(late))
    own._score = lambda d: d.select("k", F.when(F.col("t") > 0, F.raise_error("broken")).alias("p"))
    with pytest.raises(Exception, match="broken"):
        own.score(late)
    assert own.store.at.number == 1 and files.names(f"{folder}/versions") == ["v00000000.json", "v00000001.json"]


def test_a_small_batch_touches_its_own_entities(spark, tmp_path):
    many = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.concat(F.lit("c"), "id").alias("who"), F.lit(5).cast("long").alias("t"), F.lit(1.0).alias("amt"), F.col("id").cast("int").alias("v"))
    store = StateStore.create(spark, f"file://{tmp_path}/s", entity_states(many, SPEC), buckets=64)
    batch = spark.range(10).select(F.concat(F.lit("n"), "id").alias("k"), F.concat(F.lit("c"), F.col("id") % 5 * 7).alias("who"), F.lit(9).cast("long").alias("t"), F.lit(2.0).alias("amt"), F.lit(1).alias("v"))
    asked = batch.select(F.col("who").alias("entity"))
    for small in (100, 2):  # broadcast, and joined
        assert sorted(r.entity for r in store.lookup(asked, small=small).collect()) == ["c0", "c14", "c21", "c28", "c7"]
    plan = store.lookup(asked)._jdf.queryExecution().optimizedPlan().toString()
    read = store.lookup(asked)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "PartitionFilters: [isnotnull(bucket" in read or "bucket#" in read.split("PartitionFilters")[1][:60]
    own = session(store)
    own.score(batch)
    delta = spark.read.parquet(f"{own.store.folder}/{own.store.at.deltas[0]}")
    assert delta.count() == 5 and own.store.states().count() == 20_000
    later = own.store.commit(own.store.lookup(asked), compact_after=1)
    assert later.at.deltas == () and later.at.number == 3 and later.states().count() == 20_000


def test_history_of_one(spark):
    one = EntitySpec(SPEC.config, 1, "k", "v")
    data = rows(spark, 40)
    state = entity_states(data.filter("t < 100"), one)
    rest = data.filter("t >= 100")
    assert all(list(r.history) == [r.v] for r in with_history(rest, state, one).collect())
    assert advanced_states(state, rest, one).count() == entity_states(data, one).count()
    with pytest.raises(ValueError):
        EntitySpec(SPEC.config, 0, "k", "v")
