"""Previous-event pointers and bounded histories by entity.

Rows of one entity and second form a bucket. A bucket is represented for later rows by its row of the smallest key (the first
one on equal keys), and all rows of a bucket have the representative of the latest strictly earlier bucket as predecessor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.sources.artifacts import content_digest, opened, sealed


def _representative(entity: str, time: str, key: str, row: str) -> Column:
    return F.min(F.struct(F.col(key).alias("k"), F.col(row).alias("r"))).over(Window.partitionBy(entity, time))["r"]


def add_pointer(df: DataFrame, *, entity: str = "cc_num", time: str = "unix_time", key: str = "trans_num", row: str = "row_idx", name: str = "previous") -> DataFrame:
    """Add the row index of each row's predecessor, -1 where there is none.

    One exchange on the entity serves both windows. ``row`` numbers the rows uniquely.
    """
    earlier = Window.partitionBy(entity).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    rows = df.repartition(F.col(entity)).withColumn("__rep", _representative(entity, time, key, row))
    return rows.withColumn(name, F.coalesce(F.last("__rep").over(earlier), F.lit(-1)).cast("long")).drop("__rep")


def add_history(df: DataFrame, length: int, *, entity: str = "cc_num", time: str = "unix_time", key: str = "trans_num", row: str = "row_idx", name: str = "history", value: str | None = None) -> DataFrame:
    """Add the array of at most ``length`` items, oldest first, that ends with the row itself.

    Items before it are the representatives of the latest earlier buckets: their row indexes, or their ``value``, null values
    included. Rows without an entity are one entity, as in ``add_pointer``.
    """
    if length < 1:
        raise ValueError("a history has at least one item")
    item = row if value is None else value
    buckets = df.groupBy(entity, time).agg(F.min_by(F.col(item), F.struct(F.col(key), F.col(row))).alias("__item"))
    earlier = Window.partitionBy(entity).orderBy(time).rowsBetween(-(length - 1), -1)
    held = F.transform(F.collect_list(F.struct("__item")).over(earlier), lambda x: x["__item"]) if length > 1 else F.array().cast(df.select(F.array(item)).schema[0].dataType)
    past = buckets.select(F.col(entity).alias("__entity"), F.col(time).alias("__time"), held.alias("__past"))
    same = F.col(entity).eqNullSafe(F.col("__entity")) & F.col(time).eqNullSafe(F.col("__time"))
    return df.join(past, same).withColumn(name, F.concat("__past", F.array(F.col(item)))).drop("__entity", "__time", "__past")


def gather_history(histories: DataFrame, matrix: DataFrame, features: list[str], *, row: str = "row_idx", history: str = "history", name: str = "sequence") -> DataFrame:
    """Histories of row indexes with the array of these rows' feature vectors, oldest first, as ``name``.

    One join on the row index; a history is bounded, so what is gathered for a row is, too. Raises where a row is missing.
    """
    items = histories.select(F.col(row).alias("__row"), F.posexplode(history).alias("__at", "__item"))
    vectors = matrix.select(F.col(row).alias("__m"), F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("__v"))
    joined = items.join(vectors, F.col("__item") == F.col("__m"), "left")
    entry = F.struct(F.col("__at").alias("at"), F.when(F.col("__m").isNull(), F.raise_error("a row of a history is not in the matrix")).otherwise(F.col("__v")).alias("v"))
    gathered = joined.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["v"]).alias(name))
    return histories.join(gathered, F.col(row) == F.col("__row")).drop("__row")


def index_record(df: DataFrame, *, row: str = "row_idx", name: str = "previous") -> dict:
    """The sealed record of a pointer index: rows, rows without a predecessor and content, after it was checked."""
    cold = check_pointers(df, row=row, name=name)
    rows, seal = content_digest(df, [row, name])
    return sealed({"type": "sequence_index", "version": 1, "rows": rows, "cold": cold, "content_sha256": seal})


def verified_index(df: DataFrame, record: dict, *, row: str = "row_idx", name: str = "previous") -> DataFrame:
    """``df``, after its record and the pointers were verified."""
    if opened(record, kind="sequence_index", version=1)["sha256"] != index_record(df, row=row, name=name)["sha256"]:
        raise ValueError("the pointers are not those of the record")
    return df


def pad_history(history: Column, length: int, fill: Column) -> Column:
    """Fill up to ``length`` items on the right."""
    return F.concat(history, F.array_repeat(fill, length - F.size(history)))


def latest_per_entity(df: DataFrame, *, entity: str = "cc_num", time: str = "unix_time", key: str = "trans_num", row: str = "row_idx") -> DataFrame:
    """The row of the latest time of each entity; on ties that of the smallest key, then the first."""
    whole = F.struct(*df.columns)
    return df.groupBy(entity).agg(F.min_by(whole, F.struct((-F.col(time)).alias("t"), F.col(key).alias("k"), F.col(row).alias("r"))).alias("last")).select("last.*")


def check_pointers(df: DataFrame, *, row: str = "row_idx", name: str = "previous") -> int:
    """Raise where a pointer does not point to an earlier row; return the number of rows without one."""
    bad, cold = df.agg(F.count_if((F.col(name) >= F.col(row)) | (F.col(name) < -1)), F.count_if(F.col(name) == -1)).first()
    if bad:
        raise ValueError(f"{bad} pointers do not point to an earlier row")
    return cold
