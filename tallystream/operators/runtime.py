"""A scoring runtime: artifacts that belong together, and sessions whose state moves only after a batch was scored whole."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators import fusion
from tallystream.operators.checks import enforce
from tallystream.operators.preprocess import Preprocessor
from tallystream.operators.transactions import add_distance, normalize_batch, prepare
from tallystream.operators.velocity import VelocityConfig
from tallystream.sources.artifacts import opened, sealed
from tallystream.sources.shared import written
from tallystream.streaming.activity import advanced_snapshot, load_snapshot, velocity_from_snapshot

Scorer = Callable[[DataFrame], DataFrame]


def lineage(fitted: dict, components: dict[str, str], hybrid: dict, state: dict) -> dict:
    """The sealed document that says which artifacts belong together."""
    digests = {"preprocessor": fitted["sha256"], "hybrid": hybrid["sha256"], "activity_state": state["sha256"]}
    return sealed({"type": "runtime", "version": 1, "artifacts": digests, "components": components, "schema_sha256": Preprocessor.from_dict(fitted).schema_digest()})


@dataclass(frozen=True)
class Runtime:
    """Loaded artifacts. ``scorers`` add a component's score to prepared rows."""

    fitted: Preprocessor
    hybrid: fusion.Hybrid
    hybrid_document: dict
    snapshot: DataFrame
    scorers: dict[str, Scorer]
    config: VelocityConfig
    keep: tuple[str, ...] = ("trans_num", "cc_num", "unix_time", "amt")

    @classmethod
    def load(cls, spark: SparkSession, document: dict, *, fitted: dict, hybrid: dict, state: dict, state_path: str, scorers: dict[str, Scorer], config: VelocityConfig = VelocityConfig()) -> Runtime:
        """Verify that all artifacts are those of the runtime's document, and load them."""
        known = opened(document, kind="runtime", version=1)
        if known["artifacts"] != {"preprocessor": fitted["sha256"], "hybrid": hybrid["sha256"], "activity_state": state["sha256"]}:
            raise ValueError("the artifacts are not those of the runtime")
        preprocessor = Preprocessor.from_dict(fitted)
        if preprocessor.schema_digest() != known["schema_sha256"]:
            raise ValueError("the preprocessor has another schema than the runtime")
        blend = fusion.Hybrid.from_dict(hybrid, known["components"])
        if set(blend.weights) != set(scorers):
            raise ValueError("the blend needs other scores")
        for name in preprocessor.shares:
            preprocessor.check_table(spark, name)
        return cls(preprocessor, blend, hybrid, load_snapshot(spark, state_path, config), scorers, config)

    def session(self) -> ScoringSession:
        return ScoringSession(self)


class ScoringSession:
    """Scores batches one after another. State and results change after a batch was scored and written whole, or, as a preview
    or where scoring fails, not at all."""

    def __init__(self, runtime: Runtime):
        self.runtime = runtime
        self.reset()

    def reset(self) -> None:
        self.snapshot, self.results, self.rows = self.runtime.snapshot, None, 0

    def score(self, submitted: DataFrame, *, commit: bool = True) -> DataFrame:
        """The scored rows of a submitted batch: prepared by ``normalize_batch``, with activity that goes on from the state, scores,
        their blend, the decision and ``prediction_id``."""
        run = self.runtime
        batch = written(normalize_batch(submitted), "submitted")
        rows = prepare(velocity_from_snapshot(add_distance(batch), self.snapshot, run.config))
        scored = run.fitted.transform(rows, list(run.keep))
        for add in run.scorers.values():
            scored = add(scored)
        scored = fusion.with_ids(run.hybrid.score(scored), "trans_num", run.hybrid_document)
        scored = written(scored, "scored")
        enforce(scored, {"hybrid_probability": F.col("hybrid_probability").between(0, 1)})
        if self.results is not None and scored.join(self.results.select("prediction_id"), "prediction_id", "left_semi").limit(1).count():
            raise ValueError("a transaction was scored before in this session")
        after = written(advanced_snapshot(self.snapshot, batch, run.config), "state") if commit else None
        if commit:
            self.snapshot, self.rows = after, self.rows + scored.count()
            self.results = scored if self.results is None else self.results.unionByName(scored)
        return scored

    def result(self, ids: list[str]) -> DataFrame:
        """The committed rows of these predictions."""
        if self.results is None:
            raise KeyError("nothing was scored")
        return fusion.by_id(self.results, ids)
