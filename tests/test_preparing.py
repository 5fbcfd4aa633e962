import json

import pytest
from pyspark.sql import functions as F

from tallystream.operators import imbalance, preprocess, profile, split
from tallystream.sources import artifacts, ledger, tables

CONFIG = preprocess.PreprocessConfig(numeric=("amt", "gap"), frequency=("merchant",), nominal=("category",), log1p=("amt",))


def parts(spark, times, start=0):
    return spark.createDataFrame([(f"k{start + i}", t, str(t), i % 3 == 0) for i, t in enumerate(times)], "trans_num string, unix_time long, trans_date_trans_time string, f boolean").withColumn("is_fraud", F.col("f").cast("int")).drop("f")


def test_split_keeps_seconds_together(spark):
    rows = parts(spark, [1, 2, 3, 4, 4, 4, 5, 6])
    train, rest = split.split(rows, split.SplitConfig(0.5))
    assert sorted(r["unix_time"] for r in train.collect()) == [1, 2, 3] and rest.count() == 5
    with pytest.raises(ValueError, match="repeat"):
        split.split(rows.union(rows))
    with pytest.raises(ValueError, match="empty"):
        split.split(parts(spark, [7, 7, 7]))


def test_manifest(spark):
    rows, later = parts(spark, [1, 2, 3, 4, 4, 4, 5, 6]), parts(spark, [10, 11, 12, 13], 100)
    m = split.split_manifest(rows, later, split.SplitConfig(0.5))
    assert m["gap_seconds"] == 4 and m["boundary_time"] == 4 and m["partitions"]["train"]["rows"] == 3
    assert m == split.split_manifest(rows.orderBy(F.desc("unix_time")), later, split.SplitConfig(0.5))
    with pytest.raises(ValueError, match="share keys"):
        split.split_manifest(rows, rows)
    with pytest.raises(ValueError, match="after"):
        split.split_manifest(rows, parts(spark, [5, 6], 100))


def features(spark, n=22):
    return spark.createDataFrame([(i, 10.0 + i, None if i == 3 else float(i % 5), f"m{i % 4}" if i < 16 else "new", ("grocery", "gas")[i % 2] if i < 20 else "late", int(i % 7 == 0)) for i in range(n)], "id int, amt double, gap double, merchant string, category string, y int")


def test_fit_on_training_rows_only(spark):
    rows = features(spark)
    fitted = preprocess.fit(rows.filter("id < 16"), CONFIG)
    assert fitted.levels == {"category": ["gas", "grocery", "__MISSING__", "__UNKNOWN__"]} and "new" not in fitted.shares["merchant"]
    out = {r["id"]: r.asDict() for r in fitted.transform(rows, ["id"]).collect()}
    assert out[21]["cat__category____UNKNOWN__"] == 1 and out[20]["freq__merchant"] == 0 and out[20]["freq__merchant__unknown"] == 1 and out[0]["freq__merchant"] == 0.25
    assert fitted.names() == ["num__log1p_amt", "num__gap", "freq__merchant", "freq__merchant__unknown", "cat__category__gas", "cat__category__grocery", "cat__category____MISSING__", "cat__category____UNKNOWN__"]
    assert all(sum(v for k, v in r.items() if k.startswith("cat__")) == 1 for r in out.values())
    assert fitted.sampler_frame(rows, ["id"]).columns == ["id", "category", "num__log1p_amt", "num__gap", "freq__merchant", "freq__merchant__unknown"]
    joined = {r["id"]: r["freq__merchant"] for r in fitted.transform(rows, ["id"], share_limit=0).collect()}
    assert joined == {k: r["freq__merchant"] for k, r in out.items()}


def test_fitted_state(spark, tmp_path):
    fitted = preprocess.fit(features(spark).filter("id < 16"), CONFIG)
    artifacts.write_json(tmp_path / "p.json.gz", fitted.to_dict())
    assert preprocess.Preprocessor.from_dict(artifacts.read_json(tmp_path / "p.json.gz")) == fitted
    with pytest.raises(ValueError, match="changed"):
        preprocess.Preprocessor.from_dict(fitted.to_dict() | {"rows": 1})
    with pytest.raises(FileExistsError):
        artifacts.write_json(tmp_path / "p.json.gz", {})


def test_fit_guards(spark):
    rows = features(spark)
    with pytest.raises(ValueError, match="training"):
        preprocess.fit(rows, CONFIG, partition="holdout")
    with pytest.raises(ValueError, match="merchant_reserved"):
        preprocess.fit(rows.withColumn("merchant", F.lit("__UNKNOWN__")), CONFIG)
    with pytest.raises(ValueError, match="amt_negative"):
        preprocess.fit(rows.withColumn("amt", F.lit(-1.0)), CONFIG)
    with pytest.raises(ValueError):
        preprocess.PreprocessConfig(numeric=("a",), log1p=("b",))
    with pytest.raises(ValueError):
        preprocess.PreprocessConfig(numeric=("a",), nominal=("a",))


def labelled(spark, good, bad):
    return spark.createDataFrame([(i, float(i), "xy"[i % 2], int(i >= good)) for i in range(good + bad)], "id int, v double, c string, y int")


def test_imbalance(spark):
    assert imbalance.class_weights(9, 3) == (12 / 18, 12 / 6)
    config = lambda s, **k: imbalance.ImbalanceConfig(s, 0.5, **k)
    under = imbalance.random_under(labelled(spark, 20, 6), "y", "id", config("random_under"))
    assert imbalance.counts(under, "y") == (12, 6)
    more, record = imbalance.training_batch(labelled(spark, 20, 6), "y", "id", ["v"], ["c"], config("smotenc", neighbors=2))
    assert imbalance.counts(more, "y") == (20, 10) and record["after"] == [20, 10]
    made = more.filter("id is null").collect()
    assert len(made) == 4 and all(20 <= r.v <= 25 and r.c in "xy" for r in made)
    assert {r["strategy"]: (r["negatives"], r["positives"]) for r in imbalance.report(13, 2, config("none"))} == {"none": (13, 2), "class_weight": (13, 2), "random_under": (4, 2), "smotenc": (13, 6)}
    sample = imbalance.negative_sample(labelled(spark, 90, 10), "y", "id", 3)
    assert imbalance.counts(sample, "y") == (30, 10) and sample.collect() == imbalance.negative_sample(labelled(spark, 90, 10).repartition(3), "y", "id", 3).collect()
    for bad in (lambda: imbalance.training_batch(under, "y", "id", [], [], config("none"), partition="holdout"), lambda: imbalance.projected(4, 3, config("random_under")), lambda: imbalance.counts(labelled(spark, 3, 0), "y"), lambda: imbalance.ImbalanceConfig("other")):
        with pytest.raises(ValueError):
            bad()


def test_profile(spark):
    rows = spark.createDataFrame([(i, 1.0 * (i % 3), float(i), "p" if i % 4 else None, int(i < 2)) for i in range(12)], "id int, a double, b double, c string, y int")
    assert {r["column"]: r["missing"] for r in profile.missing(rows).collect()} == {"id": 0, "a": 0, "b": 0, "c": 3, "y": 0}
    assert profile.summary(rows, "y", "b", ["c"]).first().asDict()["ratio"] == 5.0
    status = {r["check"]: r["status"] for r in profile.quality_checks(rows, {"null": F.col("c").isNull(), "low": F.col("b") < 1, "ok": F.col("b") < 0}, {"low": 1}).collect()}
    assert status == {"null": "REVIEW", "low": "KNOWN_DATASET_ARTIFACT", "ok": "PASS"}
    ranks = {r["id"]: r["a"] for r in profile.average_ranks(rows, ["a", "b"], "id").collect()}
    assert ranks[0] == 2.5 and ranks[1] == 6.5 and ranks[2] == 10.5
    assert profile.bottom_k(rows, "id", 5).collect() == profile.bottom_k(rows.repartition(5), "id", 5).collect()
    assert profile.stratified_bottom_k(rows, "id", "y", {0: 3, 1: 5}).count() == 5
    assert profile.without_personal(rows.withColumn("first", F.lit("N")).withColumn("amt", F.lit(1.0))).columns == ["amt"]


def test_ledger(spark):
    texts = [c for c in ledger.LEDGER_COLUMNS if c.endswith(("json", "sha256"))]
    columns = "prediction_id string, created_at_utc string, updated_at_utc string, reviewer_label string, fraud_probability double, decision_threshold double, fraud_flag int, " + ", ".join(f"{c} string" for c in texts) + ", context_depth int"
    row = lambda at, label, p=0.9: ("p1", f"2024-01-0{at}", f"2024-01-0{at}", label, p, 0.5, 1, *["{}"] * 4, 3)
    empty = spark.createDataFrame([], columns)
    once = ledger.record(empty, spark.createDataFrame([row(1, "false_positive")], columns))
    twice = ledger.record(once, spark.createDataFrame([row(5, "confirm_fraud", 0.1)], columns)).collect()
    assert len(twice) == 1 and (twice[0].reviewer_label, twice[0].fraud_probability, twice[0].created_at_utc, twice[0].updated_at_utc) == ("confirm_fraud", 0.9, "2024-01-01", "2024-01-05")
    with pytest.raises(ValueError, match="fraud_probability"):
        ledger.record(empty, spark.createDataFrame([row(1, "false_positive", 1.5)], columns))
    with pytest.raises(ValueError):
        ledger.newest(once, 0)


def test_files(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    assert artifacts.file_digest(tmp_path / "x") == "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"
    assert artifacts.digest({"b": 1, "a": [2]}) == artifacts.digest(json.loads('{"a": [2], "b": 1}'))
    with pytest.raises(ValueError):
        artifacts.opened(artifacts.sealed({"type": "x"}), kind="y")
    source = tmp_path / "t.csv"
    names = [f.name for f in tables.TRANSACTION.fields]
    source.write_text(",".join(["", *names[1:]]) + "\n0,2020-01-01 00:00:01,0123,m,c,1.5,f,l,F,s,c,NY,01234,1,2,3,j,1980-01-01,t0,5,1,2,0\n")
    rows = tables.read_csv(spark, str(source))
    assert (rows.first().cc_num, rows.first().zip, rows.first().row_idx) == ("0123", "01234", 0)
    tables.write_csv(rows, str(tmp_path / "out"), gzip=True)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_csv(rows, str(tmp_path / "out"))
    assert [r["row_idx"] for r in tables.chained(rows, rows).orderBy("row_idx").collect()] == [0, 1]
