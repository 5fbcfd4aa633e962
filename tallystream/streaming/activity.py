"""States of causal activity by entity: made of rows, saved and verified, gone on from, and advanced.

An event's second stays open until a later second of the entity arrives: events of one second see the same past even if they come
in different batches. The stream on such states is in ``keyed``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystream.functions.scalars import cents
from tallystream.operators.checks import enforce
from tallystream.operators.velocity import VelocityConfig
from tallystream.sources.artifacts import canonical, sealed, table_record, verified_table

class ActivityState:
    """Committed buckets inside the longest window, lifetime totals, and the open bucket."""

    def __init__(self, windows: tuple[int, ...], saved: tuple | None = None):
        self.windows = windows
        self.open, self.open_n, self.open_cents, self.total_n, self.total_cents, times, counts, sums = saved or (None, 0, 0, 0, 0, [], [], [])
        self.buckets = list(zip(times, counts, sums, strict=True))

    def saved(self) -> tuple:
        times, counts, sums = (list(x) for x in zip(*self.buckets, strict=True)) if self.buckets else ([], [], [])
        return (self.open, self.open_n, self.open_cents, self.total_n, self.total_cents, times, counts, sums)

    def add(self, t: int, amount: int) -> list[int] | None:
        """Counts and cents of each window and of the lifetime before ``t``; None for an event that comes too late."""
        if self.open is not None and t < self.open:
            return None
        if self.open is None or t > self.open:
            if self.open_n:
                self.buckets.append((self.open, self.open_n, self.open_cents))
                self.total_n, self.total_cents = self.total_n + self.open_n, self.total_cents + self.open_cents
            self.open, self.open_n, self.open_cents = t, 0, 0
            start = t - max(self.windows)
            self.buckets = [b for b in self.buckets if b[0] >= start]
        out: list[int] = []
        for w in self.windows:
            inside = [b for b in self.buckets if b[0] >= t - w]
            out += [sum(b[1] for b in inside), sum(b[2] for b in inside)]
        self.open_n, self.open_cents = self.open_n + 1, self.open_cents + amount
        return [*out, self.total_n, self.total_cents]


def _money_rows(rows: DataFrame, config: VelocityConfig) -> DataFrame:
    """(entity, t, n, c) of rows."""
    return rows.select(F.col(config.entity).alias("entity"), F.col(config.time).cast("long").alias("t"), F.lit(1).cast("long").alias("n"), cents(F.col(config.amount)).alias("c"))


def _buckets(snapshot: DataFrame, config: VelocityConfig) -> DataFrame:
    """A snapshot as (entity, t, n, c, all_n, all_c): its buckets, the open one included, and a row before the longest window
    that holds what of the lifetime's totals is in none of them."""
    total = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)
    piece = lambda t, n, c, all_n, all_c: F.struct(t.alias("t"), n.alias("n"), c.alias("c"), all_n.alias("all_n"), all_c.alias("all_c"))
    zero, col = F.lit(0).cast("long"), F.col
    past = F.transform(F.arrays_zip(col("times").alias("t"), col("counts").alias("n"), col("sums").alias("c")), lambda b: piece(b["t"], b["n"], b["c"], b["n"], b["c"]))
    rest = piece(col("open") - max(config.windows) - 1, zero, zero, col("total_n") - total("counts"), col("total_cents") - total("sums"))
    return snapshot.select("entity", F.inline(F.concat(past, F.array(rest, piece(col("open"), col("open_n"), col("open_cents"), col("open_n"), col("open_cents"))))))


def _folded(pieces: DataFrame, config: VelocityConfig) -> DataFrame:
    """The state of each entity from (entity, t, n, c, all_n, all_c), null entities being one: its last second stays open, and
    seconds within the longest window before it are kept, of which there are at most as many as the window is long."""
    buckets = pieces.groupBy("entity", "t").agg(*[F.sum(c).alias(c) for c in ("n", "c", "all_n", "all_c")])
    last = buckets.groupBy(F.col("entity").alias("__e")).agg(F.max_by(F.struct("t", "n", "c"), "t").alias("last"), F.sum("all_n").alias("__n"), F.sum("all_c").alias("__c"))
    kept = buckets.filter("n > 0").join(last, F.col("entity").eqNullSafe(F.col("__e"))).filter(F.col("t") >= F.col("last.t") - max(config.windows))
    one = kept.groupBy("entity").agg(F.first("last").alias("last"), F.first("__n").alias("all_n"), F.first("__c").alias("all_c"), F.array_sort(F.collect_list(F.when(F.col("t") < F.col("last.t"), F.struct("t", "n", "c")))).alias("past"))
    return one.select(
        "entity", F.col("last.t").alias("open"), F.col("last.n").alias("open_n"), F.col("last.c").alias("open_cents"), (F.col("all_n") - F.col("last.n")).alias("total_n"), (F.col("all_c") - F.col("last.c")).alias("total_cents"),
        *[F.col(f"past.{c}").alias(name) for c, name in (("t", "times"), ("n", "counts"), ("c", "sums"))],
    )


def state_snapshot(history: DataFrame, config: VelocityConfig) -> DataFrame:
    """The state after all rows of ``history``, by entity (rows without one are one entity): what a later file or stream starts
    from."""
    return _folded(_money_rows(history, config).select("*", F.col("n").alias("all_n"), F.col("c").alias("all_c")), config)


def refuse_late(rows: DataFrame, snapshot: DataFrame, config: VelocityConfig) -> None:
    """Raise if a row is earlier than its entity's open second."""
    opened_at = snapshot.select(F.col("entity").alias("__e"), F.col("open").alias("__o"))
    late = rows.select(F.col(config.entity).alias("__r"), F.col(config.time).alias("__t")).join(opened_at, F.col("__r").eqNullSafe(F.col("__e")))
    if late.filter("__t < __o").limit(1).count():
        raise ValueError("rows are earlier than the snapshot")


def velocity_from_snapshot(df: DataFrame, snapshot: DataFrame, config: VelocityConfig) -> DataFrame:
    """``add_velocity`` of later rows that go on from a snapshot: its buckets stand in for the rows before.

    Raises if a row is earlier than its entity's open second.
    """
    refuse_late(df, snapshot, config)
    entry = lambda rows, *more: rows.select(F.col(config.entity if rows is df else "entity").alias("__e"), F.col(config.time if rows is df else "t").cast("long").alias("__t"), *more)
    own = entry(df, F.lit(1).cast("long").alias("__n"), cents(F.col(config.amount)).alias("__c"), F.struct(*df.columns).alias("__row"))
    older = entry(_buckets(snapshot, config), F.col("n").alias("__n"), F.col("c").alias("__c"), F.lit(None).cast(own.schema["__row"].dataType).alias("__row"), F.col("all_n").alias("__an"), F.col("all_c").alias("__ac"))
    rows = own.select("*", F.col("__n").alias("__an"), F.col("__c").alias("__ac")).unionByName(older)
    # Running totals: what enters a window leaves it by a row of its own, so an entity of very many rows costs no more for each.
    effect = lambda w, delay, sign: F.struct(F.lit(w).cast("int").alias("w"), F.lit(delay).cast("long").alias("delay"), F.lit(sign).cast("long").alias("sign"))
    effects = [effect(None, 0, 1), *[effect(i, w, -1) for i, w in enumerate(config.windows)]]
    spread = rows.withColumn("__x", F.explode(F.array(*effects)))
    enters = F.col("__x.w").isNull()
    spread = spread.select("__e", (F.col("__t") + F.col("__x.delay")).alias("__t"), F.col("__x.w").alias("__w"), *[(F.col(c) * F.col("__x.sign")).alias(c) for c in ("__n", "__c")], *[F.when(enters, F.col(c)).alias(c) for c in ("__an", "__ac", "__row")])
    before = Window.partitionBy("__e").orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    names, out = config.names(), {}
    for i, w in enumerate([*config.windows, None]):
        mine = F.col("__w").isNull() | (F.col("__w") == i)
        n, c = (F.when(mine, F.col("__n")), F.when(mine, F.col("__c"))) if w is not None else (F.col("__an"), F.col("__ac"))
        out |= {names[2 * i]: F.coalesce(F.sum(n).over(before), F.lit(0)), names[2 * i + 1]: F.coalesce(F.sum(c).over(before), F.lit(0)) / F.lit(100.0)}
    return spread.withColumns(out).filter("__row is not null").select("__row.*", *names)


#: Version of saved states.
STATE_VERSION = 1


def save_snapshot(snapshot: DataFrame, config: VelocityConfig, path: str, *, overwrite: bool = False) -> dict:
    """Write a snapshot and its sealed document: version, configuration, rows and content. Returns the document."""
    mode = "overwrite" if overwrite else "errorifexists"
    snapshot.write.mode(mode).parquet(f"{path}/state")
    saved = snapshot.sparkSession.read.parquet(f"{path}/state")
    document = table_record(saved, "activity_state") | {"state_version": STATE_VERSION, "config": {k: list(v) if isinstance(v, tuple) else v for k, v in vars(config).items()}}
    document = sealed(document)
    snapshot.sparkSession.createDataFrame([(canonical(document).decode(),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/document")
    return document


def load_snapshot(spark: SparkSession, path: str, config: VelocityConfig) -> DataFrame:
    """A saved snapshot, after version, configuration and content were verified, and that every bucket is in order."""
    document = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/document").collect()))  # one line
    if document.get("state_version") != STATE_VERSION:
        raise ValueError("the state has another version")
    if document["config"] != {k: list(v) if isinstance(v, tuple) else v for k, v in vars(config).items()}:
        raise ValueError("the state was made with another configuration")
    snapshot = verified_table(spark.read.parquet(f"{path}/state"), document, "activity_state")
    ordered = F.forall(F.sequence(F.lit(1), F.size("times")), lambda i: (F.get("times", i - 1) < F.coalesce(F.get("times", i), F.col("open"))) & (F.get("counts", i - 1) > 0)) | (F.size("times") == 0)
    enforce(snapshot, {"buckets": ordered, "counts": (F.col("total_n") >= 0) & (F.col("open_n") >= 0)})
    return snapshot


def advanced_snapshot(snapshot: DataFrame, rows: DataFrame, config: VelocityConfig) -> DataFrame:
    """The state after further rows, from the state before them; rows earlier than an entity's open second are an error."""
    refuse_late(rows, snapshot, config)
    own = _money_rows(rows, config).select("*", F.col("n").alias("all_n"), F.col("c").alias("all_c"))
    return _folded(own.unionByName(_buckets(snapshot, config)), config)
