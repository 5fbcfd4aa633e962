"""Profiles, checks, scalars, correlations and samples over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.functions import scalars
from tallystream.operators import checks, profile
from tallystream.plans import tables

_LABELLED = "(SELECT *, CAST(event_type = 'error' AS INTEGER) AS label FROM events)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).withColumn("label", (F.col("event_type") == "error").cast("int"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up coordinates of nations: fixed functions of the key."""
    n = F.col("n_nationkey")
    return tables.table(spark, sf_dir, "nation").select(n, ((n * 37) % 180 - 90).cast("double").alias("lat"), ((n * 101) % 360 - 180).cast("double").alias("lon"))


_PLACES = "(SELECT n_nationkey, CAST((n_nationkey * 37) % 180 - 90 AS DOUBLE) AS lat, CAST((n_nationkey * 101) % 360 - 180 AS DOUBLE) AS lon FROM nation)"


def haversine_nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every pair of nations (25 rows each side, whatever the scale)."""
    a, b = _places(spark, sf_dir), _places(spark, sf_dir).toDF("other", "lat2", "lon2")
    return a.join(F.broadcast(b), a["n_nationkey"] < b["other"]).select("n_nationkey", "other", F.round(scalars.haversine_km(*[F.col(c) for c in ("lat", "lon", "lat2", "lon2")]), 6).alias("km"))


def customer_supplier_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation, and the mean distance to the suppliers' nations weighted by suppliers."""
    customers = tables.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    suppliers = tables.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("other")).agg(F.count("*").alias("suppliers"))
    places = _places(spark, sf_dir)
    rows = customers.join(places, "n_nationkey").crossJoin(F.broadcast(suppliers.join(places.toDF("other", "lat2", "lon2"), "other")))  # at most 25 nations a side
    km = scalars.haversine_km(*[F.col(c) for c in ("lat", "lon", "lat2", "lon2")])
    return rows.groupBy("n_nationkey", "customers").agg(F.round(F.sum(km * F.col("suppliers")) / F.sum("suppliers"), 6).alias("mean_km"))


def geo_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by one-degree cell of their customer's nation and status."""
    n = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = tables.orders(spark, sf_dir).join(n, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(_places(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    return profile.label_counts(rows, "o_orderstatus", **profile.geo_cell(F.col("lat") / 7, F.col("lon") / 7))


def cents_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.lineitem(spark, sf_dir)
    out = [(F.col("l_extendedprice"), "price"), (F.col("l_extendedprice") * (1 - F.col("l_discount")), "net")]
    return rows.agg(*[F.count_if(~scalars.cents_valid(c)).alias(f"{n}_invalid") for c, n in out], *[F.sum(scalars.cents(c)).alias(f"{n}_cents") for c, n in out[:1]])


def event_seconds_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are whole seconds."""
    k = F.get_json_object("props", "$.k")
    rows = tables.events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(k, F.lit(".5"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("x"), k)).otherwise(k).alias("raw"))
    return rows.select("event_id", scalars.event_seconds(F.col("raw")).alias("seconds"))


def coordinates_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = (F.col("event_id") % 200 - 100).cast("double"), (F.col("event_id") % 400 - 200).cast("double")
    return tables.events(spark, sf_dir).select("event_id", scalars.coordinates_valid(lat, lon).alias("valid"))


def time_backsteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the dates of orders and a second clock step back in the order of the keys."""
    rows = tables.orders(spark, sf_dir).withColumn("u", F.col("t") % 1000003)
    return checks.backsteps(rows, ["t", "u"], "o_orderkey")


def key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.lineitem(spark, sf_dir).withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return checks.duplicate_keys(rows, "key").agg(F.count("*").alias("repeated"), F.sum("count").alias("rows"))


def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders of both kinds of status."""
    rows = tables.orders(spark, sf_dir)
    return checks.shared_keys(rows.filter("o_orderstatus = 'F'"), rows.filter("o_orderstatus = 'O'"), "o_custkey")


def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("priority"))
    return profile.missing(rows).select("column", "missing", F.round("share", 6).alias("share"))


def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.lineitem(spark, sf_dir)
    rules = {"price": ~scalars.cents_valid(F.col("l_extendedprice")), "quantity": F.col("l_quantity") <= 0, "discount": ~F.col("l_discount").between(0, 1), "flag": ~F.col("l_returnflag").isin("R", "A")}
    return profile.quality_checks(rows, rules)


def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.summary(_labelled(spark, sf_dir), "label", "value", ["user_id", "event_type"])
    return out.select("rows", "positives", "negatives", F.round("rate", 6).alias("rate"), F.round("ratio", 6).alias("ratio"), "cents", "least", "most", "distinct_user_id", "distinct_event_type")


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.lineitem(spark, sf_dir)
    return rows.agg(*[F.count_distinct(F.col(c)).alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")])


def hourly_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.label_counts(_labelled(spark, sf_dir), "label", hour=profile.calendar_keys(F.col("ts"))["hour"])


def weekday_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.label_counts(_labelled(spark, sf_dir), "label", weekday=profile.calendar_keys(F.col("ts"))["weekday"])


def weekly_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.label_counts(_labelled(spark, sf_dir), "label", week=profile.calendar_keys(F.col("ts"))["week"])
    return out.withColumn("week", F.date_format("week", "yyyy-MM-dd"))


def category_label_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir).withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return profile.label_pivot(rows, "o_orderpriority", "label", 250).withColumn("rate", F.round("rate", 6))


def top_groups_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of the highest share of returns."""
    rows = tables.lineitem(spark, sf_dir).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return profile.label_pivot(rows, "l_suppkey", "label", 5).orderBy(F.desc("rate"), "l_suppkey").limit(15).withColumn("rate", F.round("rate", 6))


def within_class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir).withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return profile.share_within_label(rows, "o_orderpriority", "label").withColumn("share", F.round("share", 6))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.pearson(tables.lineitem(spark, sf_dir), _NUMBERS).select("a", "b", F.round("r", 6).alias("r"))


def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.orders(spark, sf_dir).withColumn("age", F.col("t") % 97)
    return profile.spearman(rows, ["o_totalprice", "t", "age"], "o_orderkey").select("a", "b", F.round("r", 6).alias("r"))


def bottom_k_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.bottom_k(tables.events(spark, sf_dir), "event_id", 500).select("event_id", "user_id", "event_type")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.stratified_bottom_k(_labelled(spark, sf_dir), "event_id", "label", {1: 100, 0: 200}).select("event_id", "label")


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyclical calendar features, age, clocks, log-odds, masks and hashes of orders."""
    rows = tables.orders(spark, sf_dir)
    p = (F.col("o_orderkey") % 1000) / F.lit(1000.0)
    hour = scalars.cyclical(F.weekday("o_orderdate"), 7)
    return rows.select(
        "o_orderkey", F.round(hour[0], 6).alias("weekday_sin"), F.round(hour[1], 6).alias("weekday_cos"), F.round(scalars.age_years(F.col("o_orderdate"), F.lit("1960-02-29").cast("date")), 6).alias("age"),
        scalars.causal_seconds(F.col("o_orderdate")).alias("causal"), F.round(scalars.logit(p), 6).alias("logit"), F.round(scalars.sigmoid(scalars.logit(p)), 6).alias("p"),
        F.round(scalars.clip(F.log1p("o_totalprice"), 10.0, 12.0), 6).alias("logged"), F.round(scalars.safe_ratio(F.col("o_totalprice"), (F.col("o_orderkey") % 3).cast("double")), 6).alias("ratio"),
        scalars.mask_tail(F.col("o_orderkey").cast("string")).alias("masked"), F.upper(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)).alias("sha"),
    )


def json_state_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties parsed, put into a record, written as JSON and read again."""
    kind = "k bigint, who struct<user:bigint,kinds:array<string>>"
    rows = tables.events(spark, sf_dir).withColumn("p", F.from_json("props", "k bigint"))
    text = F.to_json(F.struct(F.col("p.k").alias("k"), F.struct(F.col("user_id").alias("user"), F.array("event_type", F.lit("x")).alias("kinds")).alias("who")))
    return rows.select("event_id", F.from_json(text, kind).alias("s")).select("event_id", "s.k", F.col("s.who.user").alias("user"), F.col("s.who.kinds")[0].alias("kind"))


QUERIES = {
    f.__name__: f
    for f in (
        haversine_nation_pairs, customer_supplier_distance, geo_bins, cents_validation, event_seconds_validation, coordinates_validation, time_backsteps, key_duplicates, key_intersection,
        missingness, quality_checks, profile_summary, distinct_counts, hourly_label, weekday_label, weekly_label, category_label_pivot, top_groups_by_rate, within_class_share,
        pearson_matrix, spearman_matrix, bottom_k_sample, stratified_sample, scalar_functions, json_state_roundtrip,
    )
}


def _km(a: str, b: str) -> str:
    d_lon = f"(((radians({b}.lon) - radians({a}.lon) + pi()) - 2 * pi() * floor((radians({b}.lon) - radians({a}.lon) + pi()) / (2 * pi()))) - pi())"
    h = f"least(greatest(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin({d_lon} / 2), 2), 0), 1)"
    return f"2 * 6371.0088 * atan2(sqrt({h}), sqrt(1 - {h}))"


_ORDERED = "(SELECT *, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders)"
_MISSING = "(SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS priority FROM orders)"
_AVG_RANK = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
_RANKS = f"(SELECT {_AVG_RANK('o_totalprice')} AS o_totalprice, {_AVG_RANK('t')} AS t, {_AVG_RANK('t % 97')} AS age FROM {tables.ORDERS})"
_P = "((o_orderkey % 1000) / 1000.0)"
_LOGIT = f"ln(least(greatest({_P}, 1e-7), 1 - 1e-7) / (1 - least(greatest({_P}, 1e-7), 1 - 1e-7)))"


def _corr(source: str, columns: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {source}" for a, b in pairs)


SQL = {
    "haversine_nation_pairs": f"SELECT a.n_nationkey, b.n_nationkey AS other, round({_km('a', 'b')}, 6) AS km FROM {_PLACES} a JOIN {_PLACES} b ON a.n_nationkey < b.n_nationkey",
    "customer_supplier_distance": f"""SELECT a.n_nationkey, c.customers, round(sum({_km('a', 'b')} * s.suppliers) / sum(s.suppliers), 6) AS mean_km
      FROM (SELECT c_nationkey AS n, count(*) AS customers FROM customer GROUP BY 1) c JOIN {_PLACES} a ON a.n_nationkey = c.n, (SELECT s_nationkey AS n, count(*) AS suppliers FROM supplier GROUP BY 1) s JOIN {_PLACES} b ON b.n_nationkey = s.n GROUP BY 1, 2""",
    "geo_bins": f"SELECT floor(lat / 7) + 0.5 AS lat_bin, floor(lon / 7) + 0.5 AS lon_bin, o_orderstatus AS label, count(*) AS rows FROM orders JOIN customer ON o_custkey = c_custkey JOIN {_PLACES} p ON p.n_nationkey = c_nationkey GROUP BY ALL",
    "cents_validation": """SELECT count(*) FILTER (WHERE NOT abs(l_extendedprice - round_even(l_extendedprice * 100, 0) / 100.0) <= 1e-9) AS price_invalid,
      count(*) FILTER (WHERE NOT abs(n - round_even(n * 100, 0) / 100.0) <= 1e-9) AS net_invalid, CAST(sum(CAST(round_even(l_extendedprice * 100, 0) AS BIGINT)) AS BIGINT) AS price_cents FROM (SELECT *, l_extendedprice * (1 - l_discount) AS n FROM lineitem)""",
    "event_seconds_validation": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS seconds FROM events",
    "coordinates_validation": "SELECT event_id, abs(event_id % 200 - 100) <= 90 AND abs(event_id % 400 - 200) <= 180 AS valid FROM events",
    "time_backsteps": f"SELECT count(*) FILTER (WHERE t < lt) AS t, count(*) FILTER (WHERE u < lu) AS u FROM (SELECT t, t % 1000003 AS u, lag(t) OVER (ORDER BY o_orderkey) AS lt, lag(t % 1000003) OVER (ORDER BY o_orderkey) AS lu FROM {tables.ORDERS})",
    "key_duplicates": "SELECT count(*) AS repeated, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "key_intersection": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "missingness": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS share FROM {_MISSING}" for c in ("o_orderkey", "price", "priority")),
    "quality_checks": "SELECT \"check\", found, CASE WHEN found = 0 THEN 'PASS' ELSE 'REVIEW' END AS status FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", count(*) FILTER (WHERE {bad}) AS found FROM lineitem"
        for n, bad in (("price", "NOT abs(l_extendedprice - round_even(l_extendedprice * 100, 0) / 100.0) <= 1e-9"), ("quantity", "l_quantity <= 0"), ("discount", "NOT l_discount BETWEEN 0 AND 1"), ("flag", "l_returnflag NOT IN ('R', 'A')"))
    )
    + ")",
    "profile_summary": f"""SELECT count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives, round(sum(label) / count(*), 6) AS rate, round(sum(1 - label) / sum(label), 6) AS ratio,
      CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS BIGINT) AS cents, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS distinct_user_id, count(DISTINCT event_type) AS distinct_event_type FROM {_LABELLED}""",
    "distinct_counts": "SELECT " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")) + " FROM lineitem",
    "hourly_label": f"SELECT CAST(hour(ts) AS INTEGER) AS hour, label, count(*) AS rows FROM {_LABELLED} GROUP BY ALL",
    "weekday_label": f"SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, label, count(*) AS rows FROM {_LABELLED} GROUP BY ALL",
    "weekly_label": f"SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, label, count(*) AS rows FROM {_LABELLED} GROUP BY ALL",
    "category_label_pivot": f"SELECT o_orderpriority, CAST(sum(1 - label) AS BIGINT) AS negatives, CAST(sum(label) AS BIGINT) AS positives, count(*) AS total, round(sum(label) / count(*), 6) AS rate FROM {_ORDERED} GROUP BY 1 HAVING count(*) >= 250",
    "top_groups_by_rate": "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS negatives, count(*) FILTER (WHERE l_returnflag = 'R') AS positives, count(*) AS total, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS rate FROM lineitem GROUP BY 1 HAVING count(*) >= 5 ORDER BY count(*) FILTER (WHERE l_returnflag = 'R') / count(*) DESC, 1 LIMIT 15",
    "within_class_share": f"SELECT o_orderpriority, label, rows, round(rows / sum(rows) OVER (PARTITION BY label), 6) AS share FROM (SELECT o_orderpriority, label, count(*) AS rows FROM {_ORDERED} GROUP BY 1, 2)",
    "pearson_matrix": _corr("lineitem", _NUMBERS),
    "spearman_matrix": _corr(_RANKS, ["o_totalprice", "t", "age"]),
    "bottom_k_sample": "SELECT event_id, user_id, event_type FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 500",
    "stratified_sample": f"SELECT event_id, label FROM {_LABELLED} QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id), event_id) <= CASE WHEN label = 1 THEN 100 ELSE 200 END",
    "scalar_functions": f"""SELECT o_orderkey, round(sin(2 * pi() / 7 * (isodow(o_orderdate) - 1)), 6) AS weekday_sin, round(cos(2 * pi() / 7 * (isodow(o_orderdate) - 1)), 6) AS weekday_cos,
      round(date_diff('day', DATE '1960-02-29', CAST(o_orderdate AS DATE)) / 365.2425, 6) AS age, t - 220924800 AS causal, round({_LOGIT}, 6) AS logit, round(1 / (1 + exp(-{_LOGIT})), 6) AS p,
      round(least(greatest(ln(1 + o_totalprice), 10.0), 12.0), 6) AS logged, round(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice / (o_orderkey % 3) END, 6) AS ratio,
      CASE WHEN length(CAST(o_orderkey AS VARCHAR)) > 4 THEN '••••' || right(CAST(o_orderkey AS VARCHAR), 4) ELSE '••••' END AS masked, upper(sha256(CAST(o_orderkey AS VARCHAR))) AS sha FROM {tables.ORDERS}""",
    "json_state_roundtrip": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id AS user, event_type AS kind FROM events",
}
