import pytest
from pyspark.sql import functions as F

from tallystream.operators import preprocess, split
from tallystream.sources import files, tables
from tallystream.sources.observed import checked_table
from test_runtime import CONFIG, features


def counted(df, folder):
    """``df`` that leaves a mark in a folder each time it is read (by one task)."""
    columns = df.columns

    def mark(batches):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    return df.select(*columns).coalesce(1).mapInPandas(mark, df.schema)


def reads(folder):
    return len(list(folder.iterdir()))


def test_fit_and_split_read_their_rows_once(spark, tmp_path):
    rows = features(spark, 50)
    want = preprocess.fit(rows, CONFIG, by=split.SplitConfig())
    got = preprocess.fit(counted(rows, tmp_path), CONFIG, by=split.SplitConfig())
    assert got == want and reads(tmp_path) == 1
    assert got.context == preprocess.bound_context(rows, split.SplitConfig())
    train, rest = split.split(counted(rows, tmp_path), split.SplitConfig())
    assert reads(tmp_path) == 2 and train.count() == 40 and rest.count() == 10


def test_tables_that_break_a_rule_are_not_kept(spark, tmp_path):
    rows, place = features(spark, 20), f"file://{tmp_path}/out"
    with pytest.raises(ValueError, match=r"amount \(3\)"):
        checked_table(rows, "t", {"amount": F.col("amt") < 27, "key": F.col("trans_num").isNotNull()})
    with pytest.raises(ValueError, match=r"amount \(3\)"):
        tables.write_csv(rows, place, rules={"amount": F.col("amt") < 27})
    assert not files.exists(place) and files.names(f"file://{tmp_path}") == []
    tables.write_csv(rows, place, rules={"amount": F.col("amt") > 0})
    with pytest.raises(FileExistsError):
        tables.write_csv(rows, place)
    with pytest.raises(ValueError, match=r"late \(19\)"):
        tables.ingest_csv(spark, place, rows.schema, {"late": F.col("unix_time") < 1001})
    assert tables.ingest_csv(spark, place, rows.schema).count() == 20
    tables.write_csv(rows.limit(2), place, overwrite=True)
    assert tables.read_csv(spark, place, rows.schema).count() == 2


def test_empty_tables(spark):
    table, n, found = checked_table(features(spark, 3).limit(0), "t", {"a": F.col("amt") > 0}, {"m": F.max("amt")})
    assert (n, found, table.count()) == (0, {"m": None}, 0)
    with pytest.raises(ValueError, match="no training rows"):
        preprocess.fit(features(spark, 3).limit(0), CONFIG)
    with pytest.raises(ValueError, match="unix_time"):
        split.split(features(spark, 9).withColumn("unix_time", F.lit(None).cast("long")))
