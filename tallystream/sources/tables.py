"""Reading and writing transaction tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystream.operators.checks import drop_export_index
from tallystream.sources import files
from tallystream.sources.observed import checked_table, observed, refuse

#: Columns of a raw transaction file and their types. Identifiers are text, so that no digit is lost.
TRANSACTION = T.StructType(
    [
        T.StructField("row_idx", T.LongType()), T.StructField("trans_date_trans_time", T.StringType()), T.StructField("cc_num", T.StringType()),
        T.StructField("merchant", T.StringType()), T.StructField("category", T.StringType()), T.StructField("amt", T.DoubleType()),
        T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("gender", T.StringType()),
        T.StructField("street", T.StringType()), T.StructField("city", T.StringType()), T.StructField("state", T.StringType()), T.StructField("zip", T.StringType()),
        T.StructField("lat", T.DoubleType()), T.StructField("long", T.DoubleType()), T.StructField("city_pop", T.LongType()), T.StructField("job", T.StringType()),
        T.StructField("dob", T.StringType()), T.StructField("trans_num", T.StringType()), T.StructField("unix_time", T.LongType()),
        T.StructField("merch_lat", T.DoubleType()), T.StructField("merch_long", T.DoubleType()), T.StructField("is_fraud", T.IntegerType()),
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TRANSACTION) -> DataFrame:
    """A CSV file with a header; its unnamed first column is the row index. Malformed rows fail."""
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=True).csv(path)


def ingest_csv(spark: SparkSession, path: str, schema: T.StructType = TRANSACTION, rules: dict[str, Column] | None = None) -> DataFrame:
    """A CSV file as a table in the shared folder, whose rows all satisfy the rules; the file is read once."""
    return checked_table(read_csv(spark, path, schema), "ingested", rules or {})[0]


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names only."""
    return spark.read.options(header=True).csv(path).columns


def head_by_index(df: DataFrame, rows: int, row: str = "row_idx") -> DataFrame:
    """The first rows of the file: a filter on the index that reaches the scan, not a limit."""
    return df.filter(F.col(row) < rows)


def chained(first: DataFrame, second: DataFrame, row: str = "row_idx", time: str | None = None) -> DataFrame:
    """Two tables one after another, rows numbered through. With ``time`` the second must not start before the first ends."""
    if time is not None:
        end, start = first.agg(F.max(time)).first()[0], second.agg(F.min(time)).first()[0]
        if end is not None and start is not None and start < end:
            raise ValueError("the second table starts before the first one ends")
    start = (first.agg(F.max(row)).first()[0] if first.limit(1).count() else -1) + 1
    return first.unionByName(second.withColumn(row, F.col(row) + start))


def write_csv(df: DataFrame, path: str, *, gzip: bool = False, overwrite: bool = False, rules: dict[str, Column] | None = None) -> None:
    """Write-once unless told otherwise. Rules are checked while rows are written, and a table that breaks one never stands at its
    place: it is written beside it, and renamed when all rows were found to be right."""
    if files.exists(path) and not overwrite:
        raise FileExistsError(f"PATH_ALREADY_EXISTS: {path}")
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"

    def write(rows: DataFrame) -> None:
        out = rows.write.options(header=True, lineSep="\n")
        (out.option("compression", "gzip") if gzip else out).csv(beside)

    broken = observed(df, write, rules or {})["broken"]
    if broken:
        files.delete(beside)
        refuse(broken)
    files.rename(beside, path, overwrite=overwrite)


def write_partitions(df: DataFrame, path: str, partition: str = "partition", *, overwrite: bool = False) -> None:
    """Model matrices as Parquet, a folder per partition."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(partition).parquet(path)


def write_features(df: DataFrame, path: str, **options: bool) -> None:
    """Feature tables without an export index."""
    write_csv(drop_export_index(df), path, **options)
