"""Classifiers of Spark ML, seeded parameter search over a chronological split, and reports."""

from __future__ import annotations

import random
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators import imbalance, metrics
from tallystream.operators.forest import Forest, fit_forest
from tallystream.sources import artifacts, files
from tallystream.sources.artifacts import digest, opened, sealed
from tallystream.sources.shared import new_path

#: File of a saved forest.
FOREST = "forest.json.gz"

#: Finite grids to draw from.
SPACES: dict[str, dict[str, list]] = {
    "logistic": {"C": [0.01, 0.1, 1.0, 10.0], "max_iter": [100]},
    "forest": {"trees": [20, 50], "depth": [6, 10], "leaf": [1, 4]},
    "boosted": {"rounds": [20, 40], "depth": [3, 5], "rate": [0.05, 0.1]},
}


def estimator(kind: str, params: dict, *, weight_total: float = 1.0, label: str = "label", weight: str = "weight", seed: int = 42):
    """The unfitted classifier. The logistic one sums its loss over weights as its C says, so C is spread over their total."""
    common = {"labelCol": label, "featuresCol": "features", "weightCol": weight}
    if kind == "logistic":
        return LogisticRegression(**common, regParam=1 / (params["C"] * weight_total), elasticNetParam=0.0, standardization=False, maxIter=params["max_iter"])
    if kind == "boosted":
        return GBTClassifier(**common, maxIter=params["rounds"], maxDepth=params["depth"], stepSize=params["rate"], seed=seed)
    raise ValueError(f"unknown model {kind}")


def sampled_parameters(kind: str, n: int, seed: int = 42) -> list[dict]:
    """``n`` distinct points of the grid, in a seeded order."""
    space = SPACES[kind]
    grid = [dict(zip(space, values, strict=True)) for values in product(*space.values())]
    return random.Random(seed).sample(grid, min(n, len(grid)))


def positive_score(probability: Column) -> Column:
    return vector_to_array(probability)[1]


def fit(kind: str, params: dict, train: DataFrame, *, label: str = "label", seed: int = 42):
    """Fit with balanced class weights on (features, label); a forest balances the sample of each of its trees."""
    if kind == "forest":
        imbalance.counts(train, label)
        return fit_forest(train, trees=params["trees"], depth=params["depth"], leaf=params["leaf"], subset="sqrt", label=label, seed=seed)
    weights = imbalance.class_weights(*imbalance.counts(train, label))
    weighted = train.withColumn("weight", imbalance.weight(F.col(label), weights))
    total = weighted.agg(F.sum("weight")).first()[0]
    model = estimator(kind, params, weight_total=total, label=label, seed=seed).fit(weighted)
    return _read_back(model) if kind == "logistic" else model


def _read_back(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The model without the summary of its fit. That holds the session, which cannot be sent to tasks any more, nor the model with
    it, once a query was observed in the session."""
    path = new_path(SparkSession.active(), "model")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def score(model, df: DataFrame, name: str = "p") -> DataFrame:
    if isinstance(model, Forest):
        return model.score(df, name)
    out = model.transform(df).withColumn(name, positive_score(F.col("probability")))
    return out.drop("probability", "rawPrediction", "prediction")


@dataclass
class SearchResult:
    kind: str
    model: object
    params: dict
    report: dict


def search(kind: str, train: DataFrame, validation: DataFrame, holdout: DataFrame | None = None, *, tries: int = 4, label: str = "label", seed: int = 42) -> SearchResult:
    """Fit each drawn candidate, rank by average precision, recall and precision on validation rows (the first wins ties),
    and score the holdout once, with the winner and its frozen threshold."""
    results = []
    for i, params in enumerate(sampled_parameters(kind, tries, seed)):
        model = fit(kind, params, train, label=label, seed=seed)
        scored = score(model, validation).select(label, "p").cache()
        report = metrics.evaluate(scored, label, "p")
        scored.unpersist()
        results.append((report["average_precision"], report["at_threshold"]["recall"], report["at_threshold"]["precision"], -i, model, params, report))
    *_, model, params, report = max(results, key=lambda r: r[:4])
    out = {"type": "model_report", "version": 1, "model": kind, "parameters": params, "validation": report}
    if holdout is not None:
        out["holdout"] = metrics.evaluate(score(model, holdout).select(label, "p"), label, "p", threshold=report["threshold"])
    return SearchResult(kind, model, params, sealed(out))


def save(model, path: str, *, overwrite: bool = False) -> str:
    """Write a model, and return the digest of its files."""
    if isinstance(model, Forest):
        artifacts.write_json(f"{path}/{FOREST}", model.to_dict(), overwrite=overwrite)
        return files_digest(SparkSession.active(), path)
    pipeline = PipelineModel(stages=[model])
    (pipeline.write().overwrite() if overwrite else pipeline.write()).save(path)
    return files_digest(SparkSession.active(), path)


def files_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names (below ``path``) and contents of all files, wherever they are stored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", F.lit(path.rstrip("/").rsplit("/", 1)[-1] + "/"), 2), -1)
    rows = files.select(name.alias("name"), F.sha2("content", 256).alias("digest")).collect()  # a row per file of a model
    return digest(sorted([r["name"], r["digest"]] for r in rows))


def load(path: str):
    if files.exists(f"{path}/{FOREST}"):
        return Forest.from_dict(artifacts.read_json(f"{path}/{FOREST}"))
    return PipelineModel.load(path)


def load_verified(spark: SparkSession, path: str, report: dict):
    """The model of a sealed report, after the report and the model's files were verified."""
    found = opened(report, kind="model_report", version=1)
    if found.get("model_sha256") != files_digest(spark, path):
        raise ValueError("the model's files are not those of the report")
    return load(path)


def linear_drivers(model, names: list[str], n: int = 8) -> Column:
    """The largest contributions of a logistic model's ``features`` vector: coefficient times value."""
    from tallystream.operators.fusion import top_drivers

    values = vector_to_array(F.col("features"))
    weights = [float(w) for w in model.coefficients]
    parts = F.array(*[F.struct(F.lit(name).alias("feature"), (values[i] * w).alias("contribution")) for i, (name, w) in enumerate(zip(names, weights, strict=True))])
    return top_drivers(parts, n)


def tree_drivers_column(model, names: list[str], n: int = 8, features: str = "features") -> Column:
    """The largest contributions of a boosted model for each row's ``features`` vector, in Arrow batches; see ``tree_drivers``."""
    from tallystream.operators.fusion import top_drivers

    explain = tree_drivers(model, names)

    @F.pandas_udf("array<struct<feature:string,contribution:double>>")
    def contributions(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: [{"feature": f, "contribution": c} for f, c in explain(v).items()])

    return top_drivers(contributions(vector_to_array(F.col(features))), n)


def tree_drivers(model, names: list[str]):
    """Contributions of a boosted model per row: along each tree's path, the change of the node's mean goes to the feature it
    splits on. Returns a function of a feature array (a list of numbers) to a dict."""
    import json

    trees = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes = json.loads(json.dumps(_nodes(tree._call_java("rootNode"))))
        trees.append((nodes, float(weight)))

    def explain(values: list[float]) -> dict[str, float]:
        out = dict.fromkeys(names, 0.0)
        for node, weight in trees:
            while "left" in node:
                below = node["left"] if values[node["feature"]] <= node["at"] else node["right"]
                out[names[node["feature"]]] += weight * (below["mean"] - node["mean"])
                node = below
        return out

    return explain


def _nodes(node) -> dict:
    out = {"mean": float(node.prediction())}
    if node.subtreeDepth() > 0:
        at = node.split()
        out |= {"feature": int(at.featureIndex()), "at": float(at.threshold()), "left": _nodes(node.leftChild()), "right": _nodes(node.rightChild())}
    return out
