import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystream.__main__ import main
from tallystream.operators import averaging, fusion, neural, transactions
from tallystream.operators.neural import TrainConfig
from tallystream.sources import artifacts
from test_transactions import raw


def report(name, **change):
    return artifacts.sealed({"type": "model_report", "version": 1, "model": name, "model_sha256": name * 8, "lineage": {"split_sha256": "A", "schema_sha256": "B"}} | change)


def scores(spark, n=300):
    draw = np.random.default_rng(0)
    y = (draw.random(n) < 0.3).astype(int)
    p = np.clip(y * 0.4 + draw.random((3, n)) * 0.6, 0, 1)
    rows = [("validation" if i % 2 else "holdout", int(y[i]), *map(float, p[:, i])) for i in range(n)]
    return spark.createDataFrame(rows, "partition string, is_fraud int, boosted double, feed_forward double, recurrent double")


def test_a_hybrid_is_searched_with_its_lineage(spark):
    rows, names = scores(spark), ("boosted", "feed_forward", "recurrent")
    parts = [rows.filter(F.col("partition") == p) for p in ("validation", "holdout")]
    chosen, document, found = fusion.search_hybrid(*parts, "is_fraud", {n: report(n) for n in names}, samples=8)
    assert document["components"] == {n: n * 8 for n in names} and fusion.Hybrid.from_dict(document, document["components"]) == chosen
    assert found["holdout"]["threshold"] == chosen.threshold == found["validation"]["threshold"] and len(found["candidates"]) == 16
    assert found["validation"]["average_precision"] == pytest.approx(max(c["average_precision"] for c in found["candidates"]), abs=1e-9)
    assert found["lineage"] == {"split_sha256": "A", "schema_sha256": "B"} and json.dumps(found)
    for wrong in ({"lineage": {"split_sha256": "A", "schema_sha256": "C"}}, {"lineage": None}):
        with pytest.raises(ValueError):
            fusion.search_hybrid(*parts, "is_fraud", {n: report(n, **(wrong if n == "recurrent" else {})) for n in names})
    with pytest.raises(ValueError, match="changed"):
        fusion.search_hybrid(*parts, "is_fraud", {n: report(n) | {"model_sha256": "x"} for n in names})
    with pytest.raises(ValueError, match="two components"):
        fusion.shared_lineage({"boosted": report("boosted")})


def test_networks_are_searched_on_all_rows(spark, monkeypatch):
    draw = np.random.default_rng(1)
    rows = spark.createDataFrame([(f"k{i}", int(a > 0.5), float(a), float(b)) for i, (a, b) in enumerate(draw.normal(size=(300, 2)))], "key string, label int, a double, b double")
    monkeypatch.setattr(neural, "SPACES", {"feed_forward": {"hidden": [(3,), (4,)], "rate": [0.01]}})
    best, found = averaging.search("feed_forward", rows, rows, inputs=["a", "b"], tries=2, epochs=2, tasks=2)
    assert len(found["tried"]) == 2 and found["tried"][found["chosen"]]["average_precision"] == best.best == max(t["average_precision"] for t in found["tried"])
    assert found["network_sha256"] == neural.to_dict(best.model, ["a", "b"])["sha256"] and isinstance(best.model.config, TrainConfig)


def test_commands(spark, tmp_path):
    folder = f"file://{tmp_path}"
    matrix, fitted = transactions.model_table(raw(spark, 120), raw(spark, 30, 120))
    matrix.withColumn("is_fraud", F.col("label")).write.parquet(f"{folder}/matrix")
    artifacts.write_json(f"{folder}/fit.json", fitted.to_dict())
    scores(spark).write.parquet(f"{folder}/scores")
    raw(spark, 60).write.parquet(f"{folder}/raw")
    main(["boost", f"{folder}/matrix", f"{folder}/b.json", f"{folder}/trees.json.gz", "--key", "trans_num", "--rounds", "2", "--state", f"{folder}/fit.json"])
    found = artifacts.read_json(f"{folder}/b.json")
    assert found["model_sha256"] == artifacts.read_json(f"{folder}/trees.json.gz")["sha256"] and found["lineage"]["schema_sha256"] == fitted.schema_digest()
    main(["index", f"{folder}/raw", f"{folder}/pointers"])
    assert artifacts.read_json(f"{folder}/pointers.json")["rows"] == 60
    for n in ("boosted", "feed_forward", "recurrent"):
        artifacts.write_json(f"{folder}/{n}.json", report(n))
    names = "boosted,feed_forward,recurrent"
    main(["hybrid", f"{folder}/scores", f"{folder}/h.json", f"{folder}/hybrid.json", "--scores", names, "--reports", ",".join(f"{folder}/{n}.json" for n in names.split(","))])
    assert artifacts.read_json(f"{folder}/h.json")["hybrid_sha256"] == artifacts.read_json(f"{folder}/hybrid.json")["sha256"]
    main(["features", f"{folder}/raw", f"{folder}/features"])
    assert spark.read.parquet(f"{folder}/features").count() == 60
    with pytest.raises(FileExistsError):
        main(["boost", f"{folder}/matrix", f"{folder}/b.json", f"{folder}/trees.json.gz", "--key", "trans_num", "--rounds", "1"])
