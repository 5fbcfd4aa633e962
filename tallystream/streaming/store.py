"""Keyed states in versions: a base table, deltas, and a small sealed document for each version that names them.

A version becomes visible by the rename of its document, which fails for all but one of the writers that start from one version. A
batch reads the states of its own entities only (the base lies in folders by a hash of the entity, of which those of the batch are
read) and writes these alone, as a delta. After ``compact_after`` deltas a new base is written. Tables that no version names (of a
writer that failed, or lost) are never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystream.sources import files
from tallystream.sources.artifacts import canonical, opened, sealed

#: Folders of a base; entities of a batch up to which they are broadcast and only their folders are read; deltas before a new base.
BUCKETS, SMALL_BATCH, COMPACT_AFTER = 256, 100_000, 16


@dataclass(frozen=True)
class Version:
    """What a version's document says."""

    number: int
    base: str
    deltas: tuple[str, ...] = ()
    results: tuple[str, ...] = ()
    rows: int = 0
    buckets: int = BUCKETS
    schema: str = ""
    lineage: dict | None = None

    def document(self) -> dict:
        return sealed({"type": "state_store", "version": 1} | {k: list(v) if isinstance(v, tuple) else v for k, v in vars(self).items()})

    @classmethod
    def read(cls, path: str) -> Version:
        d = opened(json.loads(files.read(path)), kind="state_store", version=1)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k not in ("type", "version", "sha256")})


class StateStore:
    """States by the column ``entity`` (null is an entity) below ``folder``, as of one version."""

    def __init__(self, spark: SparkSession, folder: str, at: Version):
        self.spark, self.folder, self.at = spark, folder.rstrip("/"), at

    @classmethod
    def create(cls, spark: SparkSession, folder: str, states: DataFrame, *, buckets: int = BUCKETS, lineage: dict | None = None) -> StateStore:
        """The first version, of these states; ``lineage`` says what they belong to and stays with all versions."""
        kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in states.schema])
        store = cls(spark, folder, Version(0, "", buckets=buckets, schema=kinds.json(), lineage=lineage))
        return store._published(replace(store.at, base=store._write_base(states)))

    @classmethod
    def open(cls, spark: SparkSession, folder: str, number: int | None = None) -> StateStore:
        """The last version, or one before it."""
        known = [int(n[1:-5]) for n in files.names(f"{folder}/versions") if n.startswith("v") and n.endswith(".json")]
        if not known or (number is not None and number not in known):
            raise FileNotFoundError(f"no such version in {folder}")
        return cls(spark, folder, Version.read(_place(folder, max(known) if number is None else number)))

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.at.schema))

    def _bucket(self, entity: Column) -> Column:
        return F.pmod(F.xxhash64(entity), F.lit(self.at.buckets)).cast("int")

    def _write_base(self, states: DataFrame) -> str:
        name = f"base-{uuid.uuid4().hex}"
        rows = states.select(*[f.name for f in self._schema()]).withColumn("bucket", self._bucket(F.col("entity")))
        rows.repartition("bucket").sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        return name

    def _published(self, version: Version) -> StateStore:
        files.write_once(_place(self.folder, version.number), canonical(version.document()))
        return StateStore(self.spark, self.folder, version)

    def _latest(self, base: DataFrame, deltas: DataFrame | None) -> DataFrame:
        """One state of each entity: that of its last delta, or else of the base."""
        if deltas is None:
            return base
        names = [f.name for f in self._schema()]
        rows = base.select(F.lit(-1).alias("__v"), *names).unionByName(deltas)
        return rows.groupBy("entity").agg(F.max_by(F.struct(*names), "__v").alias("s")).select("s.*")

    def _deltas(self) -> DataFrame | None:
        if not self.at.deltas:
            return None
        kinds = T.StructType([*self._schema(), T.StructField("__v", T.IntegerType())])
        return self.spark.read.schema(kinds).parquet(*[f"{self.folder}/{name}" for name in self.at.deltas])

    def _base(self) -> DataFrame:
        kinds = T.StructType([*self._schema(), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/{self.at.base}")

    def states(self) -> DataFrame:
        """All states."""
        return self._latest(self._base().drop("bucket"), self._deltas())

    def lookup(self, entities: DataFrame, *, small: int = SMALL_BATCH) -> DataFrame:
        """The states of these entities (the column ``entity``), as far as there are any."""
        own = entities.select(F.col("entity").alias("__e")).distinct()
        base, deltas = self._base(), self._deltas()
        if (few := own.limit(small + 1).count()) <= small:
            used = own.select(self._bucket(F.col("__e")).alias("b")).distinct().collect() if few else []  # a row per folder
            base, own = base.filter(F.col("bucket").isin([r["b"] for r in used])), F.broadcast(own)
        mine = lambda rows: rows.join(own, F.col("entity").eqNullSafe(F.col("__e")), "left_semi")
        return self._latest(mine(base.drop("bucket")), mine(deltas) if deltas is not None else None)

    def results(self) -> DataFrame | None:
        """What the versions' batches gave, all of it."""
        return self.spark.read.parquet(*[f"{self.folder}/{name}" for name in self.at.results]) if self.at.results else None

    def commit(self, states: DataFrame, results: DataFrame | None = None, *, compact_after: int = COMPACT_AFTER) -> StateStore:
        """The next version: ``states`` replace those of their entities, ``results`` are added. ``FileExistsError`` where another
        writer has made it meanwhile; then nothing has changed."""
        name, number = uuid.uuid4().hex, self.at.number + 1
        states.select(*[f.name for f in self._schema()], F.lit(number).alias("__v")).write.parquet(f"{self.folder}/delta-{name}")
        version = replace(self.at, number=number, deltas=(*self.at.deltas, f"delta-{name}"))
        if results is not None:
            results.write.parquet(f"{self.folder}/results-{name}")
            rows = self.spark.read.parquet(f"{self.folder}/results-{name}").count()
            version = replace(version, results=(*self.at.results, f"results-{name}"), rows=self.at.rows + rows)
        made = self._published(version)
        return made.compacted() if len(version.deltas) > compact_after else made

    def compacted(self) -> StateStore:
        """The next version, of one base with the same states."""
        return self._published(replace(self.at, number=self.at.number + 1, base=self._write_base(self.states()), deltas=()))


def _place(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/versions/v{number:08d}.json"
