"""Feature streams bound to their sources, benchmark rows, measured plans, references of scores, the form of a batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystream.operators import drift, models, transactions
from tallystream.operators.prepared import Places, benchmark_rows, ensure_streams, register_sources
from tallystream.operators.sequences import add_history
from tallystream.operators.velocity import VelocityConfig, add_velocity, measured_plan
from tallystream.sources import files, tables
from tallystream.sources.artifacts import read_json
from tallystream.streaming.activity import load_snapshot, state_snapshot

CONFIG = VelocityConfig((50, 400), "who", "t", "amt")
same = lambda rows: rows


def past(spark, n, start=0):
    draw = np.random.default_rng(n)
    return spark.createDataFrame([(start + i, None if i % 9 == 0 else f"c{i % 4}", 1000 + 7 * (start + i), float(draw.integers(1, 900)) / 4) for i in range(n)], "id long, who string, t long, amt double")


def places_of(spark, folder, n=60, m=25):
    places = Places.below(f"file://{folder}")
    past(spark, n).write.parquet(places.development)
    past(spark, m, n).write.parquet(places.holdout)
    return places


def test_streams_go_on_and_are_made_once(spark, tmp_path):
    places = places_of(spark, tmp_path)
    register_sources(spark, places)
    made = ensure_streams(spark, places, CONFIG, prepare=same)
    both = past(spark, 60).unionByName(past(spark, 25, 60))
    assert made["development"].unionByName(made["holdout"]).exceptAll(add_velocity(both, CONFIG)).count() == 0
    assert load_snapshot(spark, places.state("holdout"), CONFIG).exceptAll(state_snapshot(both, CONFIG)).count() == 0
    before = read_json(places.record("holdout"))

    def fails(rows):
        raise AssertionError("made again")

    again = ensure_streams(spark, places, CONFIG, prepare=fails)
    assert again["holdout"].count() == 25 and read_json(places.record("holdout")) == before
    with pytest.raises(ValueError, match="configuration"):
        ensure_streams(spark, places, VelocityConfig((50,), "who", "t", "amt"), prepare=same)
    files.delete(places.state("holdout"))
    with pytest.raises(RuntimeError, match="holdout"):
        ensure_streams(spark, places, CONFIG, prepare=same)


def test_changed_sources_are_refused(spark, tmp_path):
    places = places_of(spark, tmp_path)
    with pytest.raises(FileNotFoundError):
        ensure_streams(spark, places, CONFIG, prepare=same)
    register_sources(spark, places)
    ensure_streams(spark, places, CONFIG, prepare=same)
    past(spark, 60).withColumn("amt", F.when(F.col("id") == 3, 1.25).otherwise(F.col("amt"))).write.mode("overwrite").parquet(places.development)
    with pytest.raises(ValueError, match="not those of its record"):
        ensure_streams(spark, places, CONFIG, prepare=same)
    with pytest.raises(FileExistsError):
        register_sources(spark, places)
    register_sources(spark, places, overwrite=True)  # the streams that are there are of the old rows
    with pytest.raises(ValueError, match="another source"):
        ensure_streams(spark, places, CONFIG, prepare=same)


def test_rows_to_time_models_on(spark):
    rows = past(spark, 80).withColumn("partition", F.when(F.col("id") < 50, "train").otherwise("validation"))
    keys = {"entity": "who", "time": "t", "key": "id", "row": "id"}
    found = benchmark_rows(rows, add_history(rows, 4, **keys).select("id", "history"), ["amt", "t"], 20, row="id")
    plain = {r.id: r for r in rows.collect()}
    got = {r.id: r for r in found.collect()}
    assert sorted(got) == list(range(50, 70))
    for i, r in got.items():
        chain = [j for j in range(i + 1) if plain[j].who == plain[i].who][-4:]
        assert r.inputs == [plain[i].amt, plain[i].t] and r.length == len(chain) and r.sequence == [[plain[j].amt, plain[j].t] for j in chain]
    with pytest.raises(ValueError, match="fewer"):
        benchmark_rows(rows, add_history(rows, 4, **keys), ["amt"], 31, row="id")


@pytest.mark.parametrize("heavy_rows, task_rows", [(10_000, 10_000), (5, 10_000), (5, 15), (10_000, 1)])
def test_measured_plan(spark, heavy_rows, task_rows):
    rows = past(spark, 100)
    plan = measured_plan(rows, CONFIG, heavy_rows=heavy_rows, task_rows=task_rows)
    assert plan["heavy"] == (heavy_rows == 5) and (plan["chunk"] is None) == (task_rows == 10_000)
    assert plan["chunk"] is None or plan["chunk"] % 400 == 0
    assert add_velocity(rows, CONFIG, **plan).exceptAll(add_velocity(rows, CONFIG)).count() == 0
    assert measured_plan(rows.limit(0), CONFIG) == {"heavy": False, "chunk": None}


def test_references_of_scores(spark):
    draw = np.random.default_rng(8)
    make = lambda a, b: spark.createDataFrame([(i, float(x), float(p)) for i, (x, p) in enumerate(zip(draw.normal(0, 1, 3000), draw.beta(a, b, 3000), strict=True))], "id int, x double, p double")
    reference, alike, moved = make(2, 8), make(2, 8), make(5, 5)
    fitted = drift.DriftDetector.fit(reference, ["x"], "id", drift.DriftConfig(max_rows=2000), p="p", context={"source": "A"})
    detector = drift.DriftDetector.from_dict(fitted.to_dict())
    assert detector.context == {"source": "A", "rows_available": 3000, "rows_sampled": 2000} and len(detector.predictions["sample"]) == 2000
    whole = drift.DriftDetector.fit(reference, ["x"], "id", p="p")
    direct = drift.score_drift(reference, moved, "p")
    found = whole.evaluate_scores(moved, "id", "p")
    assert {k: pytest.approx(found[k]) if k != "status" else found[k] for k in direct} == direct
    report = detector.report(moved, "id", "p", "later")
    assert report["overall"] == report["scores"]["status"] == "critical" and report["summary"]["overall"] == "stable" and report["rows"] == 3000
    assert detector.report(alike, "id", "p", "alike")["overall"] == "stable"
    with pytest.raises(ValueError, match="score"):
        detector.evaluate_scores(moved.withColumn("p", F.col("p") + 1), "id", "p")
    with pytest.raises(ValueError, match="without scores"):
        drift.DriftDetector.fit(reference, ["x"], "id").evaluate_scores(moved, "id", "p")


def test_form_of_a_batch(spark, tmp_path):
    form = transactions.batch_template(spark)
    assert set(transactions.REQUIRED) <= set(form.columns)
    tables.write_csv(form, f"{tmp_path}/form")
    back = spark.read.options(header=True).csv(f"{tmp_path}/form")
    row = transactions.normalize_batch(back).first()
    assert row.trans_num == "row-1" and row.unix_time is not None and row.amt == 12.5


def test_models_score_after_a_query_was_observed(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 5}
    rows = spark.createDataFrame([(Vectors.dense(float(i), float(i % 3)), int(i > 20)) for i in range(40)], ["features", "label"])
    for kind, params in (("logistic", {"C": 1.0, "max_iter": 20}), ("boosted", {"rounds": 2, "depth": 2, "rate": 0.1}), ("forest", {"trees": 3, "depth": 2, "leaf": 1})):
        assert models.score(models.fit(kind, params, rows), rows).filter("p between 0 and 1").count() == 40
