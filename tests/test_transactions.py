import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystream.operators import transactions
from tallystream.operators.fusion import Hybrid
from tallystream.operators.velocity import VelocityConfig
from tallystream.streaming.activity import state_snapshot


def raw(spark, n, start=0):
    draw = np.random.default_rng(n)
    rows = []
    for i in range(n):
        t = 1_577_836_800 + (start + i) * 1800
        rows.append((i, f"c{i % 5}", f"m{i % 7}", ("grocery", "gas")[i % 2], float(10 + i % 50), "N", "L", "F", "st", "city", ("NY", "CA")[i % 3 == 0], "01234", 40.0, -74.0, 1000 + i, "job", "1980-05-17", f"k{start + i}", t, 40.0 + float(draw.random()), -74.5, int(i % 7 == 0)))
    columns = "row_idx long, cc_num string, merchant string, category string, amt double, first string, last string, gender string, street string, city string, state string, zip string, lat double, long double, city_pop long, job string, dob string, trans_num string, unix_time long, merch_lat double, merch_long double, is_fraud int"
    return spark.createDataFrame(rows, columns).withColumn("trans_date_trans_time", F.date_format(F.timestamp_seconds("unix_time"), "yyyy-MM-dd HH:mm:ss"))


def test_model_table(spark):
    matrix, fitted = transactions.model_table(raw(spark, 100), raw(spark, 20, 100))
    assert len(fitted.names()) == 11 + 7 + 2 * 4 + 4 + 4 and not any("cc_num" in n or "first" in n for n in fitted.names())
    counts = {(r.partition, r.label): r.rows for r in transactions.partition_counts(matrix).collect()}
    assert sum(v for (p, _), v in counts.items() if p == "train") == 80 and sum(v for (p, _), v in counts.items() if p == "holdout") == 20
    assert matrix.filter("partition = 'holdout' and previous = -1").count() == 0


def test_profile(spark):
    out = transactions.transaction_profile(raw(spark, 60), sample=10, positives=3)
    assert out["summary"].first().distinct_cc_num == 5 and out["sample"].count() == 10 and out["label_sample"].count() == 13
    assert not {"first", "cc_num", "trans_num", "street"} & set(out["sample"].columns)
    assert {r.status for r in out["quality"].collect()} == {"PASS"} and out["backsteps"].first().asDict() == {"unix_time": 0, "display": 0}


def test_guards(spark):
    rows = raw(spark, 5)
    with pytest.raises(ValueError, match="coordinates"):
        transactions.engineer_features(rows.withColumn("lat", F.lit(91.0)))
    assert np.isnan(transactions.engineer_features(rows.withColumn("lat", F.lit(91.0)), invalid="nan").first().distance_card_merchant_km)
    with pytest.raises(ValueError, match="dob"):
        transactions.prepare(rows.withColumn("dob", F.lit("2999-01-01")))
    with pytest.raises(ValueError, match="trans_date_trans_time"):
        transactions.prepare(rows.withColumn("trans_date_trans_time", F.lit("1/2/2020")))


def test_score_batch(spark):
    past, new = raw(spark, 100), raw(spark, 10, 100)
    _, fitted = transactions.model_table(past, new)
    snapshot = state_snapshot(past, VelocityConfig())
    scorers = {"a": lambda d: d.withColumn("a", F.lit(0.2)), "b": lambda d: d.withColumn("b", F.lit(0.8))}
    out = transactions.score_batch(new, snapshot, fitted, scorers, Hybrid({"a": 0.5, "b": 0.5}, "logit", 0.4), keep=["trans_num"])
    assert all(r.hybrid_probability == pytest.approx(0.5) and r.predicted_fraud for r in out.collect())
    whole, _ = transactions.model_table(past, new)
    name = "num__log1p_cc_txn_count_prior"
    assert {r.trans_num: r[name] for r in out.collect()} == {r.trans_num: r[name] for r in whole.filter("partition = 'holdout'").collect()}


def test_drift_simulation(spark):
    draw = np.random.default_rng(0)
    make = lambda s: spark.createDataFrame([(i, *map(float, r), float(p)) for i, (r, p) in enumerate(zip(draw.normal(size=(1000, 4)), draw.random(1000), strict=True))], "id int, a double, b double, c double, d double, p double")  # noqa: ARG005, E731
    out = transactions.drift_simulation(make(0), make(1), ["a", "b", "c", "d"], "id")
    assert out["reference"]["features"]["overall"] == "stable" and out["injected"]["features"]["overall"] == "critical" and out["injected"]["scores"]["status"] != "stable"
