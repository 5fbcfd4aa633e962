import pytest
from pyspark.sql import functions as F

from tallystream.functions import scalars
from tallystream.operators import checks
from tallystream.operators.velocity import VelocityConfig, add_velocity, check_amounts, parse_window, window_label


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_idx long, cc_num string, unix_time long, amt double")


def results(df):
    return {r["row_idx"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("heavy", [False, True])
def test_ties_and_boundary(spark, heavy):
    got = results(add_velocity(frame(spark, [("A", 1000, 10.0), ("A", 1000, 20.0), ("B", 1000, 999.0), ("A", 4600, 5.0), ("A", 4601, 7.0)]), heavy=heavy))
    pair = lambda i, w: (got[i][f"cc_txn_count_{w}"], got[i][f"cc_amt_sum_{w}"])
    assert pair(0, "prev_1h") == pair(1, "prev_1h") == pair(2, "prior") == (0, 0.0)
    assert pair(3, "prev_1h") == (2, 30.0)
    assert pair(4, "prev_1h") == (1, 5.0)
    assert pair(3, "prior") == (2, 30.0) and pair(3, "prev_6h") == (2, 30.0) and pair(4, "prior") == (3, 35.0)


def test_cents_do_not_depend_on_order(spark):
    rows = [("A", 100, 0.10), ("A", 100, 0.20), ("A", 200, 1.0), ("A", 300, 2.0)]
    for order in (rows, [rows[1], rows[0], *rows[2:]]):
        assert results(add_velocity(frame(spark, order)))[2]["cc_amt_sum_prev_1h"] == 0.30


def test_unsorted_input(spark):
    got = results(add_velocity(frame(spark, [("A", 200, 2.0), ("A", 100, 1.0)])))
    assert [got[i]["cc_txn_count_prior"] for i in (0, 1)] == [1, 0]


def test_heavy_equals_plain(spark):
    rows = [("AB"[i % 2], (i * i * 37) % 9000, float(i % 13)) for i in range(400)]
    config = VelocityConfig((60, 3600))
    key = ["row_idx", *config.names()]
    assert sorted(add_velocity(frame(spark, rows), config).select(key).collect()) == sorted(add_velocity(frame(spark, rows), config, heavy=True).select(key).collect())


def test_currency(spark):
    with pytest.raises(ValueError, match="two decimals"):
        check_amounts(frame(spark, [("A", 1, 0.001)]), "amt")
    check_amounts(frame(spark, [("A", 1, 0.01), ("A", 1, 12345678.91)]), "amt")


def test_windows():
    assert [window_label(w) for w in (3600, 90, 120, 86400)] == ["1h", "90s", "2m", "24h"]
    assert parse_window("6h") == 21600 and parse_window("5m") == 300
    for bad in ((), (0,), (5, 5)):
        with pytest.raises(ValueError):
            VelocityConfig(bad)
    with pytest.raises(ValueError):
        parse_window("0h")


def test_haversine(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), (0.0, 179.5, 0.0, -179.5)], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(scalars.haversine_km(*[F.col(c) for c in "abcd"])).collect()]
    assert got == pytest.approx([0, 111.195, 111.195], rel=1e-4)


def test_coordinates_and_seconds(spark):
    rows = spark.createDataFrame([("91.0", "0"), ("NaN", "x"), ("-90", "1.5"), (None, "12")], "lat string, t string")
    lat = F.col("lat").cast("double")
    assert [r[0] for r in rows.select(scalars.coordinates_valid(lat, F.lit(10.0))).collect()] == [False, False, True, False]
    assert [r[0] for r in rows.select(scalars.event_seconds(F.col("t"))).collect()] == [0, None, None, 12]
    with pytest.raises(ValueError, match="place"):
        checks.enforce(rows, {"place": scalars.coordinates_valid(lat, F.lit(0.0))})


def test_text_scalars(spark):
    row = spark.range(1).select(scalars.mask_tail(F.lit("123")).alias("a"), scalars.mask_tail(F.lit("123456")).alias("b"), scalars.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("c"), scalars.sigmoid(scalars.logit(F.lit(0.3))).alias("d"), scalars.plain(F.lit(float("nan"))).alias("e")).first()
    assert (row.a, row.b, row.c, row.e) == ("••••", "••••3456", 0.0, None) and row.d == pytest.approx(0.3)
    keyed = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string").select(scalars.row_key(["y", "x"], F.col("x"))).collect()
    assert len({r[0] for r in keyed}) == 2


def test_checks(spark):
    rows = spark.createDataFrame([(0, "a", 5, 1), (1, "b", 4, 2), (2, "b", 9, 1), (3, "c", 9, 7)], "row_idx long, k string, t long, u long")
    assert checks.backsteps(rows, ["t", "u"], "row_idx").first().asDict() == {"t": 1, "u": 1}
    assert [r["k"] for r in checks.duplicate_keys(rows, "k").collect()] == ["b"]
    with pytest.raises(ValueError, match="missing columns: x, y"):
        checks.require_columns(rows, ["y", "k", "x"])
    assert checks.drop_export_index(rows.withColumnRenamed("u", "Unnamed: 0")).columns == ["row_idx", "k", "t"]
    with pytest.raises(ValueError, match="lose digits"):
        checks.normalize_transactions(rows.withColumn("card", F.lit(1.5)), ["card"], text=["card"], numeric=[])
    with pytest.raises(ValueError, match="positive"):
        checks.normalize_transactions(rows.withColumn("z", F.lit(0)), ["k", "z"], text=["k"], numeric=["z"], positive=["z"])
    assert checks.normalize_transactions(rows.withColumn("k", F.lit(" q ")), ["k"], text=["k"], numeric=[]).first().k == "q"
