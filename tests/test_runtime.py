import json

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallystream.functions.ranges import cuts_by, exact_quantiles, value_counts
from tallystream.operators import fusion, imbalance, latency, models, neural, preprocess, profile, runtime, sequences, split, transactions
from tallystream.operators.velocity import VelocityConfig, add_velocity
from tallystream.sources import artifacts, ledger
from tallystream.streaming.activity import advanced_snapshot, load_snapshot, save_snapshot, state_snapshot
from test_transactions import raw

BY = split.SplitConfig()


def test_histories_keep_null_entities_and_items(spark):
    rows = spark.createDataFrame([(0, "a", 1, "k", 4.0), (1, "a", 2, "k", None), (2, "a", 3, "k", 5.0), (3, None, 1, "k", 6.0), (4, None, 2, "k", None)], "row_idx long, cc_num string, unix_time long, trans_num string, v double")
    got = {r.row_idx: list(r.history) for r in sequences.add_history(rows, 3, value="v").collect()}
    assert got == {0: [4.0], 1: [4.0, None], 2: [4.0, None, 5.0], 3: [6.0], 4: [6.0, None]}


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_are_exact(spark, n):
    draw = np.random.default_rng(n)
    rows = [(float(a), float(b)) for a, b in zip(draw.normal(size=n), draw.integers(0, 4, n), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("a", "b")])))
    shares = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    got = exact_quantiles(value_counts(long), cuts_by(df, ["a", "b"]), shares)
    for i, c in enumerate("ab"):
        assert got[c] == pytest.approx(np.quantile([r[i] for r in rows], shares).tolist(), abs=1e-12)
    assert exact_quantiles(value_counts(long.filter("false")), {"a": []}, shares) == {}


def test_large_samples_are_the_same_rows(spark):
    rows = spark.range(3000).withColumn("id", F.col("id") % 2900)  # some keys repeat
    for k in (1, 40, 1777, 2999, 3000, 4000):
        small = sorted(r.id for r in profile.bottom_k(rows, "id", k).collect())
        assert sorted(r.id for r in profile.bottom_k(rows, "id", k, top_rows=5).collect()) == small and len(small) == min(k, 3000)


def test_chunks_equal_the_whole(spark):
    draw = np.random.default_rng(3)
    rows = [(i, None if i % 5 == 0 else f"c{i % 3}", int(t), float(a)) for i, (t, a) in enumerate(zip(draw.integers(-500, 4000, 400), draw.integers(1, 900, 400) / 4, strict=True))]
    df, config = spark.createDataFrame(rows, "id int, cc_num string, unix_time long, amt double"), VelocityConfig((50, 300))
    want = sorted(map(tuple, add_velocity(df, config).select("id", *config.names()).collect()))
    for heavy in (False, True):
        assert sorted(map(tuple, add_velocity(df, config, chunk=300, heavy=heavy).select("id", *config.names()).collect())) == want
    with pytest.raises(ValueError, match="chunk"):
        add_velocity(df, config, chunk=299)


def features(spark, n=40):
    rows = [(f"k{i}", 1000 + i, str(i), int(i % 3 == 0), 10.0 + i, f"m{i % 4}", "xy"[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "trans_num string, unix_time long, trans_date_trans_time string, is_fraud int, amt double, merchant string, category string")


CONFIG = preprocess.PreprocessConfig(numeric=("amt",), frequency=("merchant",), nominal=("category",))


def test_fitting_is_bound_to_the_manifest(spark):
    rows = features(spark)
    development, holdout = rows.filter("unix_time < 1030"), rows.filter("unix_time >= 1030")
    manifest = split.split_manifest(development, holdout, BY)
    train, rest = split.split(development, BY)
    fitted = preprocess.fit(train, CONFIG, by=BY, manifest=manifest)
    assert fitted.context["split_sha256"] == manifest["sha256"] and preprocess.Preprocessor.from_dict(fitted.to_dict()) == fitted
    split.check_partition(rest, manifest, "validation")
    first = F.col("trans_num") == "k0"
    moved = {
        "rows": train.filter(~first), "last_time": train.withColumn("unix_time", F.when(F.col("trans_num") == "k23", 1028).otherwise(F.col("unix_time"))),
        "positives": train.withColumn("is_fraud", F.when(first, 0).otherwise(F.col("is_fraud"))),
        "key_sha256": train.withColumn("unix_time", F.when(F.col("trans_num") == "k5", 1006).when(F.col("trans_num") == "k6", 1005).otherwise(F.col("unix_time"))),
    }
    for name, changed in moved.items():
        with pytest.raises(ValueError, match=name):
            preprocess.fit(changed, CONFIG, by=BY, manifest=manifest)
        with pytest.raises(ValueError, match="not those of the fit"):
            imbalance.training_batch(changed, "is_fraud", "trans_num", ["amt"], ["category"], imbalance.ImbalanceConfig(), fitted=fitted, by=BY)
    for broken in (manifest | {"gap_seconds": 3}, artifacts.sealed(manifest | {"gap_seconds": -3}), artifacts.sealed({k: v for k, v in manifest.items() if k != "roles"})):
        with pytest.raises(ValueError):
            split.load_manifest(broken)
    with pytest.raises(ValueError, match="not those of validation"):
        split.check_partition(rest.filter("unix_time <> 1025"), manifest, "validation")
    batch, record = imbalance.training_batch(train, "is_fraud", "trans_num", ["amt"], ["category"], imbalance.ImbalanceConfig("random_under", 0.9), fitted=fitted, by=BY)
    assert imbalance.counts(batch, "is_fraud") == tuple(record["after"]) and record["split_sha256"] == manifest["sha256"] and record["schema_sha256"] == fitted.schema_digest()
    for odd in (train.unionByName(train), train.withColumn("is_fraud", F.lit(2))):
        with pytest.raises(ValueError):
            imbalance.training_batch(odd, "is_fraud", "trans_num", [], [], imbalance.ImbalanceConfig())


def test_numbers_and_shares(spark, tmp_path):
    rows = features(spark)
    for bad, rule in (("nan", "amt_finite"), ("x1", "amt_malformed"), ("inf", "amt_finite")):
        with pytest.raises(ValueError, match=rule):
            preprocess.fit(rows.withColumn("amt", F.when(F.col("trans_num") == "k3", bad).otherwise(F.col("amt").cast("string"))), CONFIG)
    with pytest.raises(ValueError, match="amt_negative"):
        preprocess.fit(rows.withColumn("amt", F.lit(-1.0)), preprocess.PreprocessConfig(numeric=("amt",), nonnegative=("amt",)))
    with pytest.raises(ValueError, match="share_path"):
        preprocess.fit(rows, CONFIG, share_limit=3)
    table = preprocess.fit(rows, CONFIG, share_limit=3, share_path=str(tmp_path / "shares"))
    plain, names = preprocess.fit(rows, CONFIG), ["trans_num"]
    assert sorted(map(tuple, table.transform(rows, names).collect())) == sorted(map(tuple, plain.transform(rows, names).collect()))
    table.check_table(spark, "merchant")
    spark.createDataFrame([("m0", 1.0)], "v string, share double").write.mode("overwrite").parquet(str(tmp_path / "shares" / "merchant"))
    with pytest.raises(ValueError, match="changed"):
        table.check_table(spark, "merchant")


def test_synthetic_rows_one_by_one(spark):
    draw = np.random.default_rng(1)
    rows = [(i, float(a), float(b), "pqr"[int(c)], int(i >= 60)) for i, (a, b, c) in enumerate(zip(draw.normal(size=80), draw.normal(size=80), draw.integers(0, 3, 80), strict=True))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string, y int")
    config = imbalance.ImbalanceConfig("smotenc", 0.8, 3, 7)
    got = sorted((r.a, r.b, r.c) for r in imbalance.smotenc(df, "y", "id", ["a", "b"], ["c"], config).filter("id is null").collect())
    bad = [r for r in rows if r[4] == 1]
    x, c = np.array([r[1:3] for r in bad]), [r[3] for r in bad]
    penalty, want = float(np.median(x.std(axis=0))), []
    for i in range(48 - 20):
        rng, base = np.random.default_rng([7, i]), i % 20
        near = sorted((j for j in range(20) if j != base), key=lambda j: (((x[j] - x[base]) ** 2).sum() + penalty**2 * (c[j] != c[base]), j))[:3]  # noqa: B023
        other = near[rng.integers(3)]
        point = x[base] + rng.random() * (x[other] - x[base])
        votes = [c[j] for j in near]
        want.append((*point.tolist(), min(sorted(set(votes)), key=lambda v: -votes.count(v))))  # noqa: B023
    assert len(got) == 28 and got == sorted(want)


def test_states_are_saved_and_go_on(spark, tmp_path):
    rows, config, path = raw(spark, 60), VelocityConfig(), str(tmp_path / "state")
    first, rest = rows.filter("row_idx < 40"), rows.filter("row_idx >= 40")
    save_snapshot(state_snapshot(first, config), config, path)
    state = load_snapshot(spark, path, config)
    assert sorted(map(tuple, advanced_snapshot(state, rest, config).collect())) == sorted(map(tuple, state_snapshot(rows, config).collect()))
    with pytest.raises(ValueError, match="configuration"):
        load_snapshot(spark, path, VelocityConfig((60,)))
    with pytest.raises(ValueError, match="earlier"):
        advanced_snapshot(state, rows.limit(1), config)
    state_snapshot(rows, config).write.mode("overwrite").parquet(f"{path}/state")
    with pytest.raises(ValueError, match="record"):
        load_snapshot(spark, path, config)


def submitted(spark, n, start):
    return raw(spark, n, start).drop("row_idx", "first", "last", "gender", "street", "is_fraud")


def test_batches(spark):
    rows = submitted(spark, 6, 0)
    out = transactions.normalize_batch(rows.drop("unix_time", "trans_num")).collect()
    assert len({r.trans_num for r in out}) == 6 and all(len(r.trans_num) == 64 for r in out)
    known = {r.trans_date_trans_time: r.unix_time for r in rows.collect()}
    assert all(r.unix_time == known[r.trans_date_trans_time] - 220_924_800 for r in out)
    partly = transactions.normalize_batch(rows.withColumn("trans_num", F.when(F.col("trans_num") == "k1", " ").otherwise(F.col("trans_num")))).collect()
    assert sorted(len(r.trans_num) for r in partly) == [2] * 5 + [64]
    for change, rule in ((("city_pop", F.lit(-1)), "city_pop"), (("dob", F.lit("2999-01-01")), "dob"), (("amt", F.lit(0.0)), "amt"), (("unix_time", F.lit("1.5")), "unix_time"), (("trans_num", F.lit("same")), "repeat"), (("zip", F.lit(" ")), "zip")):
        with pytest.raises(ValueError, match=rule):
            transactions.normalize_batch(rows.withColumn(*change))
    with pytest.raises(ValueError, match="at least one"):
        transactions.normalize_batch(rows.limit(0))


def test_runtime(spark, tmp_path):
    past, config, path = raw(spark, 100), VelocityConfig(), str(tmp_path / "state")
    matrix, fitted = transactions.model_table(past, raw(spark, 10, 100))
    state = save_snapshot(state_snapshot(past, config), config, path)
    components = {"a": "0" * 64, "b": "1" * 64}
    hybrid = fusion.Hybrid({"a": 0.5, "b": 0.5}, "logit", 0.4).to_dict(components)
    document = runtime.lineage(fitted.to_dict(), components, hybrid, state)
    scorers = {"a": lambda d: d.withColumn("a", F.lit(0.2)), "b": lambda d: d.withColumn("b", F.lit(0.8))}
    load = lambda **k: runtime.Runtime.load(spark, document, **({"fitted": fitted.to_dict(), "hybrid": hybrid, "state": state, "state_path": path, "scorers": scorers} | k))
    for wrong in ({"scorers": {"a": scorers["a"]}}, {"hybrid": fusion.Hybrid({"a": 1.0, "b": 0.0}, "logit", 0.4).to_dict(components)}):
        with pytest.raises(ValueError):
            load(**wrong)
    session = load().session()
    preview = session.score(submitted(spark, 10, 100), commit=False)
    assert preview.count() == 10 and session.rows == 0 and session.results is None
    first = {r.trans_num: r for r in session.score(submitted(spark, 10, 100)).collect()}
    assert session.rows == 10 and {r.prediction_id for r in first.values()} == {r.prediction_id for r in preview.collect()}
    name = "num__log1p_cc_txn_count_prior"
    assert {k: r[name] for k, r in first.items()} == {r.trans_num: r[name] for r in matrix.filter("partition = 'holdout'").collect()}
    with pytest.raises(ValueError, match="before"):
        session.score(submitted(spark, 1, 109))
    with pytest.raises(ValueError):
        session.score(submitted(spark, 3, 0))
    assert session.rows == 10
    session.score(submitted(spark, 5, 110))
    whole = {r.entity: (r.open, r.total_n + r.open_n) for r in state_snapshot(past.unionByName(raw(spark, 15, 100)), config).collect()}
    assert {r.entity: (r.open, r.total_n + r.open_n) for r in session.snapshot.collect()} == whole
    ids = [r.prediction_id for r in first.values()][:3]
    assert session.result(ids).count() == 3
    with pytest.raises(KeyError):
        session.result(["none"])
    session.reset()
    assert session.rows == 0 and session.snapshot.count() == 5


def test_ledger_versions_and_export(spark, tmp_path):
    texts = [c for c in ledger.LEDGER_COLUMNS if c.endswith(("json", "sha256"))]
    columns = "prediction_id string, created_at_utc string, updated_at_utc string, reviewer_label string, fraud_probability double, decision_threshold double, fraud_flag int, " + ", ".join(f"{c} string" for c in texts) + ", context_depth int"
    review = lambda i, label: spark.createDataFrame([(i, "2024-01-01", "2024-01-01", label, 0.9, 0.5, 1, *["{}"] * 4, 3)], columns)
    folder = str(tmp_path / "ledger")
    assert ledger.store(spark, folder, review("p1", "false_positive")) == 1 and ledger.store(spark, folder, review("p2", "confirm_fraud")) == 2
    (tmp_path / "ledger" / "v00000003").mkdir()  # another writer has begun
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        ledger.store(spark, folder, review("p3", "confirm_fraud"))
    rows = spark.read.parquet(f"{folder}/v00000002")
    assert ledger.export_csv(rows, str(tmp_path / "out")) == 2 and spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ledger.LEDGER_COLUMNS
    assert ledger.export_csv(rows.limit(0), str(tmp_path / "none")) == 0 and not [f for f in (tmp_path / "none").glob("*.csv") if f.read_text().count("\n") > 1]


def test_networks_are_kept_and_searched():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 3))
    y = (x[:, 0] + 0.3 * draw.normal(size=400) > 1).astype(int)
    fitted, report = neural.search("feed_forward", ["a", "b", "c"], x[:300], y[:300], x[300:], y[300:], tries=3, epochs=4)
    assert fitted.best == max(r["average_precision"] for r in report["tried"]) and len(report["tried"]) == 3
    document = json.loads(artifacts.canonical(neural.to_dict(fitted.model, ["a", "b", "c"])))
    again = neural.from_dict(document, ["a", "b", "c"])
    assert np.array_equal(again.predict(x), fitted.model.predict(x)) and document["sha256"] == report["network_sha256"]
    with pytest.raises(ValueError):
        neural.from_dict(document, ["a", "c", "b"])
    with pytest.raises(ValueError):
        neural.from_dict(artifacts.sealed(document | {"weights": document["weights"] | {"bias": [1.0, 2.0]}}))
    histories = (np.stack([x[:300].reshape(100, 3, 3)]).reshape(100, 3, 3), np.full(100, 3))
    lstm, _ = neural.search("recurrent", ["a", "b", "c"], histories, y[:300:3], histories, y[:300:3], tries=1, epochs=1)
    assert np.array_equal(neural.from_dict(neural.to_dict(lstm.model, ["a", "b", "c"])).predict(histories), lstm.model.predict(histories))
    value, slope = neural._gelu(np.array([0.0, 1.0, -2.0]))
    assert value == pytest.approx([0.0, 0.841344746, -0.045500264]) and slope == pytest.approx([0.5, 1.083315, -0.085232], abs=1e-5)


def test_reports_and_drivers(spark, tmp_path):
    draw = np.random.default_rng(0)
    rows = spark.createDataFrame([(Vectors.dense(a, b), int(a > 0.6)) for a, b in draw.random((300, 2)).tolist()], ["features", "label"])
    model = models.fit("boosted", {"rounds": 3, "depth": 2, "rate": 0.3}, rows)
    drivers = rows.limit(5).withColumn("d", models.tree_drivers_column(model, ["a", "b"], 2)).collect()
    assert all(r.d[0].feature == "a" and len(r.d) == 2 for r in drivers)
    seal = models.save(model, str(tmp_path / "m"))
    report = artifacts.sealed({"type": "model_report", "version": 1, "model": "boosted", "model_sha256": seal})
    assert models.load_verified(spark, str(tmp_path / "m"), report) is not None
    with pytest.raises(ValueError, match="files"):
        models.load_verified(spark, str(tmp_path / "m"), artifacts.sealed(report | {"model_sha256": "0" * 64}))


def test_records_of_tables(spark):
    rows = features(spark)
    record = artifacts.table_record(rows)
    assert artifacts.verified_table(rows.repartition(3), record).count() == 40
    for other in (rows.limit(39), rows.drop("amt"), rows.withColumn("amt", F.col("amt") + 1)):
        with pytest.raises(ValueError):
            artifacts.verified_table(other, record)


def test_latency_and_candidates(spark):
    table = latency.latency_table(spark, {"m": lambda n: sum(range(n))}, 300, repeats=5)
    rows = {r.batch: r for r in table.collect()}
    assert set(rows) == {1, 32, 256} and all(0 <= r.p50_ms <= r.p95_ms <= r.p99_ms for r in rows.values())
    with pytest.raises(ValueError):
        latency.measured("m", lambda n: None, 10)
    tried = fusion.candidates(["x", "f", "l"], 12, 0.05)
    assert len(tried) == 24 and all(abs(sum(c["weights"].values()) - 1) < 1e-12 and min(c["weights"].values()) >= 0.05 - 1e-12 for c in tried)
    assert list(tried[1]["weights"].values()) == pytest.approx([0.05 + 0.85 * 0.70, 0.05 + 0.85 * 0.05, 0.05 + 0.85 * 0.25]) and tried[0]["space"] == "probability" and tried[12]["space"] == "logit"


def test_gathered_histories_and_index(spark):
    rows = spark.createDataFrame([(0, "a", 1, "k"), (1, "a", 2, "k"), (2, None, 2, "k"), (3, "a", 3, "k")], "row_idx long, cc_num string, unix_time long, trans_num string")
    matrix = rows.select("row_idx", (F.col("row_idx") * 10.0).alias("x"), F.lit(1.0).alias("y.z"))
    histories = sequences.add_history(rows, 2).select("row_idx", "history")
    got = {r.row_idx: [list(v) for v in r.sequence] for r in sequences.gather_history(histories, matrix, ["x", "y.z"]).collect()}
    assert got == {0: [[0.0, 1.0]], 1: [[0.0, 1.0], [10.0, 1.0]], 2: [[20.0, 1.0]], 3: [[10.0, 1.0], [30.0, 1.0]]}
    with pytest.raises(Exception, match="not in the matrix"):
        sequences.gather_history(histories, matrix.filter("row_idx <> 1"), ["x"]).collect()
    pointers = sequences.add_pointer(rows).select("row_idx", "previous")
    record = sequences.index_record(pointers)
    assert (record["rows"], record["cold"]) == (4, 2) and sequences.verified_index(pointers, record).count() == 4
    with pytest.raises(ValueError):
        sequences.verified_index(pointers.withColumn("previous", F.lit(-1)), record)


def test_sampler_frames_and_missing(spark):
    rows = features(spark)
    fitted = preprocess.fit(rows, CONFIG)
    frame = fitted.sampler_frame(rows, ["trans_num"])
    assert fitted.from_sampler_frame(frame, ["trans_num"]).exceptAll(fitted.transform(rows, ["trans_num"])).count() == 0
    for name, value in (("category", F.lit("zz")), ("num__amt", F.lit(float("nan")))):
        with pytest.raises(ValueError, match=name):
            fitted.from_sampler_frame(frame.withColumn(name, value))
    assert profile.missing(rows.withColumn("gap", F.when(F.col("unix_time") > 1001, 1)), only=True).collect()[0][:2] == ("gap", 2)


def test_drift_refuses_odd_numbers(spark):
    from tallystream.operators.drift import DriftDetector

    rows = spark.range(50).withColumn("x", F.when(F.col("id") == 3, float("inf")).otherwise(F.col("id").cast("double")))
    with pytest.raises(ValueError, match="x_finite"):
        DriftDetector.fit(rows, ["x"], "id")
    detector = DriftDetector.fit(rows.filter("id <> 3"), ["x"], "id")
    with pytest.raises(ValueError, match="x_finite"):
        detector.evaluate(rows, "id")


def test_tables_in_order_of_time(spark):
    from tallystream.sources.tables import chained

    rows = spark.createDataFrame([(0, 5), (1, 6)], "row_idx long, unix_time long")
    assert chained(rows, rows.withColumn("unix_time", F.col("unix_time") + 1), time="unix_time").count() == 4
    with pytest.raises(ValueError, match="before"):
        chained(rows, rows, time="unix_time")
