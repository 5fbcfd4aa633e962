"""Three scorers and their blend as verified documents, applied together; and sessions that score submitted transactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators import fusion, neural, trees
from tallystream.operators.preprocess import Preprocessor
from tallystream.operators.transactions import REQUIRED, add_distance, engineer_features, normalize_batch, prepare
from tallystream.operators.velocity import VelocityConfig
from tallystream.sources import artifacts
from tallystream.sources.artifacts import opened, sealed
from tallystream.sources.shared import drop_table, written
from tallystream.streaming.batches import BatchSession
from tallystream.streaming.entities import EntitySpec, entity_states
from tallystream.streaming.store import StateStore

#: Component scores: the columns and the documents' names.
COMPONENTS = ("boosted", "feed_forward", "recurrent")
DRIVERS = 8
#: Files of an engine.
BLEND, RUNTIME, FITTED = "hybrid.json", "runtime.json", "preprocessor.json.gz"


@dataclass(frozen=True)
class Engine:
    """The boosted trees, both networks and the blend, made for the same inputs; ``length`` is that of a history."""

    boosted: trees.Ensemble
    feed_forward: neural.FeedForward
    recurrent: neural.Recurrent
    blend: fusion.Hybrid
    document: dict
    length: int

    @classmethod
    def of(cls, documents: dict[str, dict], hybrid: dict, length: int, inputs: list[str] | None = None) -> Engine:
        """From sealed documents. Each must be the one that the blend was made for, and all of the same inputs."""
        if set(documents) != set(COMPONENTS):
            raise ValueError(f"an engine has the components {', '.join(COMPONENTS)}")
        inputs = list(documents["boosted"].get("inputs", [])) if inputs is None else list(inputs)
        blend = fusion.Hybrid.from_dict(hybrid, {name: d.get("sha256") for name, d in documents.items()})
        if set(blend.weights) != set(COMPONENTS) or length < 1:
            raise ValueError("the blend is not one of the components' scores")
        networks = {name: neural.from_dict(documents[name], inputs) for name in COMPONENTS[1:]}
        if any(documents[name]["network"] != name for name in networks):
            raise ValueError("a network is of another kind than its name says")
        return cls(trees.Ensemble.from_dict(documents["boosted"], inputs), networks["feed_forward"], networks["recurrent"], blend, hybrid, length)

    @classmethod
    def load(cls, folder: str, length: int, inputs: list[str] | None = None) -> Engine:
        """From the files that ``save`` wrote."""
        documents = {name: artifacts.read_json(f"{folder}/{name}.json.gz") for name in COMPONENTS}
        return cls.of(documents, artifacts.read_json(f"{folder}/{BLEND}"), length, inputs)

    def predict(self, vectors: np.ndarray, histories: list) -> dict[str, np.ndarray]:
        """The component scores of rows and of their histories, which end with the rows themselves."""
        if len(vectors) == 0:
            return {name: np.empty(0) for name in COMPONENTS}
        if vectors.shape[1] != len(self.boosted.names) or any(not 1 <= len(h) <= self.length for h in histories):
            raise ValueError("rows or histories do not have the engine's shape")
        return {"boosted": self.boosted.probability(vectors), "feed_forward": self.feed_forward.predict(vectors), "recurrent": self.recurrent.predict(neural.tensor(histories, self.length))}

    def score(self, df: DataFrame, vector: str = "vector", history: str = "history", *, drivers: int = DRIVERS) -> DataFrame:
        """Add the component scores, the largest contributions of the boosted one, and the blend with its decision. All scorers
        run in one pass, in Arrow batches."""
        out = df.withColumns({name: F.lit(0.0) for name in COMPONENTS} | {"drivers": F.lit(None).cast(trees.DRIVERS)})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = np.stack(batch[vector]).astype(float) if len(batch) else np.empty((0, len(self.boosted.names)))
                found = self.predict(x, [np.stack(h) for h in batch[history]])
                yield batch.assign(**found, drivers=trees.largest(self.boosted.names, self.boosted.contributions(x), drivers))

        return self.blend.score(df.mapInPandas(run, out.schema))


def save(folder: str, documents: dict[str, dict], blend: fusion.Hybrid, fitted: Preprocessor, *, length: int, overwrite: bool = False) -> dict:
    """Write an engine and its preprocessor, and return the blend's document."""
    hybrid = blend.to_dict({name: documents[name]["sha256"] for name in COMPONENTS})
    Engine.of(documents, hybrid, length, fitted.names())
    for name, document in [*((f"{n}.json.gz", documents[n]) for n in COMPONENTS), (FITTED, fitted.to_dict()), (BLEND, hybrid)]:
        artifacts.write_json(f"{folder}/{name}", document, overwrite=overwrite)
    return hybrid


@dataclass(frozen=True)
class ScoringChain:
    """All that scores submitted transactions: preprocessor, engine and the store of states, which belong together."""

    spark: SparkSession
    fitted: Preprocessor
    engine: Engine
    store: StateStore
    config: VelocityConfig

    @classmethod
    def build(cls, spark: SparkSession, folder: str, past: DataFrame, *, length: int, config: VelocityConfig = VelocityConfig(), buckets: int = 256) -> ScoringChain:
        """Make the states after all ``past`` transactions and seal what belongs together, for the engine saved in ``folder``."""
        fitted = Preprocessor.from_dict(artifacts.read_json(f"{folder}/{FITTED}"))
        engine = Engine.load(folder, length, fitted.names())
        rows = _vectors(engineer_features(past, config), fitted)
        lineage = {"hybrid": engine.document["sha256"], "preprocessor": fitted.to_dict()["sha256"]}
        StateStore.create(spark, f"{folder}/states", entity_states(rows, _spec(config, length)), buckets=buckets, lineage=lineage)
        first = StateStore.open(spark, f"{folder}/states", 0)
        document = {"type": "scoring_chain", "version": 1, "artifacts": lineage, "states": first.at.document()["sha256"], "length": length, "config": {k: list(v) if isinstance(v, tuple) else v for k, v in vars(config).items()}}
        artifacts.write_json(f"{folder}/{RUNTIME}", sealed(document))
        return cls.load(spark, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> ScoringChain:
        """Verify every document, that they are those of the chain, and the tables they name; then load them."""
        d = opened(artifacts.read_json(f"{folder}/{RUNTIME}"), kind="scoring_chain", version=1)
        document = artifacts.read_json(f"{folder}/{FITTED}")
        fitted = Preprocessor.from_dict(document)
        engine = Engine.load(folder, d["length"], fitted.names())
        first = StateStore.open(spark, f"{folder}/states", 0)
        if d["artifacts"] != {"hybrid": engine.document["sha256"], "preprocessor": document["sha256"]} or first.at.lineage != d["artifacts"] or first.at.document()["sha256"] != d["states"]:
            raise ValueError("the artifacts are not those of the scoring chain")
        for name in fitted.shares:
            fitted.check_table(spark, name)
        config = VelocityConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in d["config"].items()})
        return cls(spark, fitted, engine, StateStore.open(spark, f"{folder}/states"), config)

    def session(self) -> TransactionSession:
        return TransactionSession(self)


def _spec(config: VelocityConfig, length: int) -> EntitySpec:
    return EntitySpec(config, length, "trans_num", "vector")


def _vectors(rows: DataFrame, fitted: Preprocessor) -> DataFrame:
    """Rows with activity, with age, calendar and distance, and ``vector``, their transformed features in order."""
    ready = prepare(rows)
    out = fitted.transform(ready, ready.columns)
    return out.select(*ready.columns, F.array(*[F.col(f"`{n}`").cast("double") for n in fitted.names()]).alias("vector"))


class TransactionSession:
    """Scores submitted batches one after another: features, histories, the three scores, their blend, drivers and ids. A batch
    takes effect as a whole, or, as a preview or where anything fails, not at all."""

    def __init__(self, chain: ScoringChain):
        self.chain = chain
        self._batches = BatchSession(chain.store, _spec(chain.config, chain.engine.length), prepare=self._prepared, score=self._scored, unique="prediction_id")

    def _prepared(self, rows: DataFrame) -> DataFrame:
        return _vectors(rows, self.chain.fitted)

    def _scored(self, rows: DataFrame) -> DataFrame:
        engine = self.chain.engine
        out = fusion.with_ids(engine.score(rows), "trans_num", engine.document)
        mode = F.when(F.col("seeded"), F.lit("continued")).otherwise(F.lit("cold_start"))
        risk = F.col("hybrid_probability")
        risk = F.when(risk.between(0, 1), risk).otherwise(F.raise_error("a score is no probability"))
        engineered = ["distance_card_merchant_km", *self.chain.config.names(), "age_years"]
        return out.select(
            "prediction_id", "scored_at_utc", F.struct(*REQUIRED, "trans_num", "unix_time").alias("transaction"), F.struct(*engineered).alias("engineered_features"),
            F.struct(*COMPONENTS).alias("component_probabilities"), risk.alias("fraud_probability"), F.lit(engine.blend.threshold).alias("decision_threshold"),
            F.col("predicted_fraud").alias("fraud_flag"), "context_depth", mode.alias("history_mode"), F.col("drivers").alias("top_drivers"), F.lit(engine.document["sha256"]).alias("model_config_sha256"),
        )

    @property
    def rows(self) -> int:
        return self._batches.rows

    @property
    def store(self) -> StateStore:
        return self._batches.store

    def score(self, submitted: DataFrame, *, commit: bool = True) -> DataFrame:
        batch = written(add_distance(normalize_batch(submitted)), "submitted")
        out = self._batches.score(batch, commit=commit)
        drop_table(batch)
        return out

    def result(self, ids: list[str]) -> DataFrame:
        return self._batches.result(ids)

    def reset(self) -> None:
        self._batches.reset()
