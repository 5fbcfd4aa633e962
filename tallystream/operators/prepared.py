"""Feature streams that are made once for given sources: where they lie, what they are of, and prepared rows to time models with.

A stream is a table of features and the state after its last row; the holdout's stream goes on from the state of the development
rows. The registry of the sources (rows, columns and content) is sealed, and every stream has a sealed record of the source that it
was made from: a source that was changed, or a stream of another source or configuration, is refused rather than used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators.sequences import gather_history
from tallystream.operators.transactions import add_distance
from tallystream.operators.velocity import VelocityConfig, add_velocity, check_amounts
from tallystream.sources import files
from tallystream.sources.artifacts import opened, read_json, sealed, table_record, verified_table, write_json
from tallystream.sources.shared import drop_table, written
from tallystream.streaming.activity import advanced_snapshot, load_snapshot, save_snapshot, state_snapshot, velocity_from_snapshot

PARTS = ("development", "holdout")


@dataclass(frozen=True)
class Places:
    """The two raw tables, and the folder of everything that is made from them. Any file system that Spark writes to."""

    development: str
    holdout: str
    folder: str

    @classmethod
    def below(cls, root: str) -> Places:
        """The usual places below one folder."""
        root = root.rstrip("/")
        return cls(f"{root}/raw/development", f"{root}/raw/holdout", f"{root}/prepared")

    def source(self, part: str) -> str:
        return getattr(self, part)

    def features(self, part: str) -> str:
        return f"{self.folder}/{part}_features"

    def state(self, part: str) -> str:
        return f"{self.folder}/{part}_state"

    def record(self, part: str) -> str:
        return f"{self.folder}/{part}_stream.json"

    @property
    def sources(self) -> str:
        return f"{self.folder}/sources.json"

    @property
    def manifest(self) -> str:
        return f"{self.folder}/split_manifest.json"

    @property
    def matrix(self) -> str:
        return f"{self.folder}/model_table"


def register_sources(spark: SparkSession, places: Places, *, overwrite: bool = False, read: Callable[[str], DataFrame] | None = None) -> dict:
    """Write the sealed registry of the two raw tables: one pass over each."""
    load = read or spark.read.parquet
    registry = sealed({"type": "feature_sources", "version": 1} | {part: table_record(load(places.source(part)), "source") for part in PARTS})
    write_json(places.sources, registry, overwrite=overwrite)
    return registry


def _there(places: Places, part: str) -> bool:
    found = {files.exists(p) for p in (places.features(part), places.state(part), places.record(part))}
    if len(found) > 1:
        raise RuntimeError(f"features, state and record of {part} must all exist, or none of them")
    return found.pop()


def ensure_streams(
    spark: SparkSession, places: Places, config: VelocityConfig = VelocityConfig(), *, prepare: Callable[[DataFrame], DataFrame] = add_distance, read: Callable[[str], DataFrame] | None = None
) -> dict[str, DataFrame]:
    """The features of both parts, made where they are absent.

    Sources must have the content that the registry says. Features and states are written beside their places and renamed when both
    are whole; the record comes last. ``ValueError`` where a source, a stream's source or its configuration differs; ``RuntimeError``
    where a stream is there in part (of a driver that was lost between two renames).
    """
    load = read or spark.read.parquet
    registry, settings, out = opened(read_json(places.sources), kind="feature_sources", version=1), sealed({"config": asdict(config)}), {}
    for i, part in enumerate(PARTS):
        if not files.exists(places.source(part)):
            raise FileNotFoundError(places.source(part))
        rows = verified_table(load(places.source(part)), registry[part], "source")
        # The holdout's stream is of the development rows, too.
        origin = {"sources": {p: registry[p]["content_sha256"] for p in PARTS[: i + 1]}, "settings": settings["sha256"]}
        if _there(places, part):
            record = opened(read_json(places.record(part)), kind="feature_stream", version=1)
            if record["origin"] != origin:
                raise ValueError(f"the stream of {part} was made from another source, or with another configuration")
            out[part] = spark.read.parquet(places.features(part))
            continue
        check_amounts(rows, config.amount)
        if i == 0:
            features, state = add_velocity(prepare(rows), config), state_snapshot(rows, config)
        else:
            before = load_snapshot(spark, places.state(PARTS[0]), config)
            features, state = velocity_from_snapshot(prepare(rows), before, config), advanced_snapshot(before, rows, config)
        beside = f"{places.folder}/{part}.{uuid.uuid4().hex}"
        features.write.parquet(f"{beside}/features")
        document = save_snapshot(state, config, f"{beside}/state")
        files.rename(f"{beside}/features", places.features(part))
        files.rename(f"{beside}/state", places.state(part))
        files.delete(beside)
        out[part] = spark.read.parquet(places.features(part))
        write_json(places.record(part), sealed({"type": "feature_stream", "version": 1, "part": part, "origin": origin, "rows": registry[part]["rows"], "state_sha256": document["sha256"]}))
    return out


def benchmark_rows(matrix: DataFrame, histories: DataFrame, features: list[str], rows: int = 256, *, part: str = "validation", row: str = "row_idx", history: str = "history") -> DataFrame:
    """The first ``rows`` rows of a partition, by row index, with ``inputs`` (array of features), ``sequence`` (their histories'
    features, oldest first) and ``length``: what models are timed on. ``histories`` has the row index and the history of indexes.

    Row indexes are unique. Raises where the partition has fewer rows; a row without a history is an error.
    """
    first = written(matrix.filter(F.col("partition") == part).select(row, F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("inputs")).orderBy(row).limit(rows), "benchmark")
    found = written(histories.join(F.broadcast(first), row).select(row, "inputs", history), "benchmark")
    n, joined = first.count(), found.count()
    drop_table(first)
    if n < rows:
        raise ValueError(f"{part} has {n} rows, fewer than {rows}")
    if joined != n:
        raise ValueError("every row must have one history")
    # Of the matrix only rows of these bounded histories are gathered.
    items = found.select(F.explode(history).alias("__item")).distinct()
    own = matrix.join(F.broadcast(items), F.col(row) == F.col("__item")).drop("__item")
    return gather_history(found, own, features, row=row, history=history).select(row, "inputs", "sequence", F.size(history).alias("length"))
