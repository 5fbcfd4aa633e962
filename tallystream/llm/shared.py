"""Helpers that several corpus operators use: the shared folder, written tables, text and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.sources.shared import drop_table, new_path, shared_dir, written

__all__ = ["drop_table", "new_path", "shared_dir", "written"]

#: A word is a maximal run of ASCII letters and digits and of all characters beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of names of rows up to which these are broadcast.
NAMES_ROWS = 500_000


def fresh(df: DataFrame) -> str:
    """A prefix that no column's name begins with, for helper columns."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def _named(docs: DataFrame, names: DataFrame, key: str, text: str) -> tuple[DataFrame, Column]:
    """``names`` (key, text_hash), broadcast if it was counted to be small, and the condition that a row has such a name.

    Null keys are names, too.
    """
    own = fresh(docs)
    names = names.select(F.col("key").alias(f"{own}key"), F.col("text_hash").alias(f"{own}hash"))
    small = names.count() <= NAMES_ROWS
    same = F.col(key).cast(names.schema[f"{own}key"].dataType).eqNullSafe(F.col(f"{own}key")) & (F.xxhash64(F.col(text)) == F.col(f"{own}hash"))
    return F.broadcast(names) if small else names, same


def drop_rows(docs: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` without the rows whose key and xxhash64 of the text are in ``names`` (key, text_hash; each once)."""
    names, same = _named(docs, names, key, text)
    return docs.join(names, same, "left_anti")


def keep_one(docs: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with one row of each name in ``names`` (key, text_hash); other rows stay."""
    if names.isEmpty():
        return docs
    names, same = _named(docs, names, key, text)
    rest, some = docs.join(names, same, "left_anti"), docs.join(names, same, "left_semi")
    one = some.groupBy(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h")).agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias("row"))
    return rest.unionByName(one.select("row.*"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """The words of ``text`` in order, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
