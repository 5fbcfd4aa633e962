"""Causal rolling and lifetime activity by entity.

The window of a row at second t is [t - w, t): its lower bound counts, the row itself and all rows of the same entity and
second do not. Money is summed as whole cents. All windows of a frame share one exchange on the entity.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions.scalars import cents, cents_valid


def window_label(seconds: int) -> str:
    """3600 -> 1h, 90 -> 90s: the largest unit that divides."""
    for unit, size in (("h", 3600), ("m", 60)):
        if seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds}s"


def parse_window(text: str) -> int:
    """Seconds of Nh, Nm or Ns."""
    found = re.fullmatch(r"(\d+)([hms])", text.strip().lower())
    if not found or int(found[1]) < 1:
        raise ValueError(f"not a positive duration: {text!r}")
    return int(found[1]) * {"h": 3600, "m": 60, "s": 1}[found[2]]


@dataclass(frozen=True)
class VelocityConfig:
    """Windows in seconds, and the names of the input columns."""

    windows: tuple[int, ...] = (3600, 21600, 86400)
    entity: str = "cc_num"
    time: str = "unix_time"
    amount: str = "amt"
    prefix: str = "cc"

    def __post_init__(self):
        if not self.windows or any(not isinstance(w, int) or w < 1 for w in self.windows) or len(set(self.windows)) < len(self.windows):
            raise ValueError("windows must be distinct positive whole seconds")
        object.__setattr__(self, "windows", tuple(sorted(self.windows)))

    def names(self) -> list[str]:
        """Output columns: count and sum of each window, then of the lifetime."""
        spans = [f"prev_{window_label(w)}" for w in self.windows] + ["prior"]
        return [f"{self.prefix}_{kind}_{span}" for span in spans for kind in ("txn_count", "amt_sum")]


def check_amounts(df: DataFrame, amount: str) -> None:
    """Raise where an amount has more than two decimals or is not finite."""
    bad = df.agg(F.count_if(~cents_valid(F.col(amount)))).first()[0]
    if bad:
        raise ValueError(f"{bad} amounts are not finite currency with at most two decimals")


#: Rows of an entity within a window from which running totals are the better plan, and rows of an entity that one task may take.
HEAVY_ROWS, TASK_ROWS = 2_000, 5_000_000


def measured_plan(df: DataFrame, config: VelocityConfig, *, heavy_rows: int = HEAVY_ROWS, task_rows: int = TASK_ROWS) -> dict:
    """The arguments of ``add_velocity`` that fit the table: ``add_velocity(df, config, **measured_plan(df, config))``.

    Rows are counted by entity and cells of time as long as the longest window, in one pass over two columns. A window lies within
    two cells: ``heavy`` where these may hold more than ``heavy_rows``. An entity of more than ``task_rows`` has its time divided
    into chunks of as many cells as surely stay below that (one at least).
    """
    span = max(config.windows)
    cells = df.groupBy(F.col(config.entity).alias("entity"), F.floor(F.col(config.time) / span).alias("cell")).agg(F.count("*").alias("n"))
    most, rows = cells.groupBy("entity").agg(F.max("n").alias("most"), F.sum("n").alias("rows")).agg(F.coalesce(F.max("most"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    return {"heavy": 2 * most > heavy_rows, "chunk": span * max(1, task_rows // most) if rows > task_rows else None}


def _money(total: Column) -> Column:
    return F.coalesce(total, F.lit(0)) / F.lit(100.0)


def add_velocity(df: DataFrame, config: VelocityConfig = VelocityConfig(), *, heavy: bool = False, chunk: int | None = None) -> DataFrame:
    """Add the columns ``config.names()``. Input order does not matter; null entities are one entity.

    ``heavy`` uses running totals with an expiry row per event and window in place of bounded frames, which Spark evaluates
    afresh for every row: the better plan where an entity has tens of thousands of events in a window. ``chunk`` (seconds, at
    least the longest window) divides each entity's time, so that one with very many rows is many tasks: a row also goes to the
    next chunk, as a past event only, and lifetime totals are carried from a total per entity and chunk.
    """
    if chunk is not None:
        return _in_chunks(df, config, chunk, heavy)
    if heavy:
        return _with_expiry(df, config)
    at, money = F.col(config.time), "__cents"
    card = Window.partitionBy(config.entity).orderBy(config.time)
    out, rows = {}, df.withColumn(money, cents(F.col(config.amount)))
    for i, w in enumerate([*config.windows, None]):
        frame = card.rangeBetween(Window.unboundedPreceding if w is None else -w, -1)
        count, total = config.names()[2 * i : 2 * i + 2]
        out |= {count: F.count(at).over(frame), total: _money(F.sum(money).over(frame))}
    return rows.withColumns(out).drop(money)


def _in_chunks(df: DataFrame, config: VelocityConfig, chunk: int, heavy: bool) -> DataFrame:
    if chunk < max(config.windows):
        raise ValueError("a chunk is at least as long as the longest window")
    own, span = F.floor(F.col(config.time) / chunk).cast("long"), max(config.windows)
    rows = df.withColumn("__own", own)
    # Only what a row of the next chunk may have in a window goes there, too.
    late = F.col(config.time) >= (F.col("__own") + 1) * chunk - span
    money = cents(F.col(config.amount))
    sums = lambda kind, keep: [F.count(F.when(keep, F.col(config.time))).alias(f"__n{kind}"), F.sum(F.when(keep, money)).alias(f"__c{kind}")]
    totals = rows.groupBy(config.entity, "__own").agg(*sums("", F.lit(True)), *sums("l", late))
    earlier = Window.partitionBy(config.entity).orderBy("__own").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(config.entity).alias("__e"), F.col("__own").alias("__o"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}b") for c in ("__n", "__c")], *[F.coalesce(f"{c}l", F.lit(0)).alias(f"{c}p") for c in ("__n", "__c")])
    # The late part of the chunk before is in the frames as well, so only what is older than it is carried over.
    last = Window.partitionBy("__e").orderBy("__o")
    there = F.lag("__o").over(last) == F.col("__o") - 1
    carried = before.select("__e", "__o", *[(F.col(f"{c}b") - F.when(there, F.lag(f"{c}p").over(last)).otherwise(0)).alias(f"{c}b") for c in ("__n", "__c")])
    both = rows.withColumn("__at", F.explode(F.when(late, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array("__own"))))
    part = VelocityConfig(config.windows, "__group", config.time, config.amount, config.prefix)
    found = add_velocity(both.withColumn("__group", F.struct(F.col(config.entity), F.col("__at"))), part, heavy=heavy).filter(F.col("__own") == F.col("__at"))
    count, total = config.names()[-2:]
    out = found.join(carried, F.col(config.entity).eqNullSafe(F.col("__e")) & (F.col("__own") == F.col("__o")))
    out = out.withColumns({count: F.col(count) + F.col("__nb"), total: (F.rint(F.col(total) * 100).cast("long") + F.col("__cb")) / F.lit(100.0)})
    return out.select(*df.columns, *config.names())


def _with_expiry(df: DataFrame, config: VelocityConfig) -> DataFrame:
    columns = df.columns
    rows = df.withColumn("__cents", cents(F.col(config.amount)))
    effects = [F.struct(F.lit(None).cast("int").alias("w"), F.lit(0).cast("long").alias("delay"), F.lit(1).alias("n"))]
    effects += [F.struct(F.lit(i).alias("w"), F.lit(w).cast("long").alias("delay"), F.lit(-1).alias("n")) for i, w in enumerate(config.windows)]
    spread = rows.withColumn("__e", F.explode(F.array(*effects))).withColumn("__t", F.col(config.time) + F.col("__e.delay"))
    # An expiry carries nothing but its entity, time and cents.
    spread = spread.withColumns({c: F.when(F.col("__e.w").isNull(), F.col(f"`{c}`")) for c in columns if c != config.entity})
    # An event leaves [t - w, t) from t = event + w + 1 on, so its expiry must be strictly earlier than that.
    before = Window.partitionBy(config.entity).orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    out = {}
    for i in range(len(config.windows) + 1):
        mine = F.col("__e.w").isNull() | (F.col("__e.w") == i)
        count, total = config.names()[2 * i : 2 * i + 2]
        out |= {count: F.coalesce(F.sum(F.when(mine, F.col("__e.n"))).over(before), F.lit(0)), total: _money(F.sum(F.when(mine, F.col("__e.n") * F.col("__cents"))).over(before))}
    return spread.withColumns(out).filter(F.col("__e.w").isNull()).select(*columns, *config.names())
