"""One query per corpus operator over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.llm.bpe import encode_documents
from tallystream.llm.centroids import cluster_vectors
from tallystream.llm.decontaminate import decontaminate
from tallystream.llm.embed_dedup import embedding_duplicates
from tallystream.llm.license_scan import PHRASES, TEMPLATES, scan_licenses
from tallystream.llm.line_dedup import drop_boilerplate
from tallystream.llm.neighbours import nearest_neighbours
from tallystream.llm.secret_scan import scan_secrets
from tallystream.llm.shared import new_path
from tallystream.llm.simhash import near_duplicates
from tallystream.llm.token_shards import write_shards
from tallystream.llm.toxicity import fit_severity, score_severity
from tallystream.llm.url_filter import judge_urls
from tallystream.llm.vector_codes import compress_vectors, with_label_error


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern and by token efficiency in every document."""
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a cosine of 0.9 or more, linked and united."""
    return embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge_urls(_table(spark, sf_dir, "pages")).drop("listed")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = _table(spark, sf_dir, "documents")
    return score_severity(docs, fit_severity(docs, _table(spark, sf_dir, "labels")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encode_documents(_table(spark, sf_dir, "documents"), keep_ids=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose 64-bit fingerprints differ in at most four bits, linked and united."""
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    little = F.lower(F.hex("print"))  # the lowest byte comes first
    return found.select("doc_id", F.concat(*[F.substring(little, 15 - 2 * i, 2) for i in range(8)]).alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of every source, dropped from its documents."""
    out = drop_boilerplate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token sequences in training order, written as shards in the shared folder."""
    return write_shards(_table(spark, sf_dir, "documents"), new_path(spark, "token-shards"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector coded by codebooks of sixteen parts, its error and that of its label."""
    found = compress_vectors(_table(spark, sf_dir, "embeddings"))
    out = with_label_error(found.rows)
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every vector whose number is divisible by 50."""
    rows = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 components with its cluster, and the inertia of clusters and of all."""
    found = cluster_vectors(_table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["s"] for r in found.rows.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # a row per centroid
    whole = sum(sums.values()) if None not in sums.values() else None
    rows = [(i, sums.get(i), whole if whole is not None and whole < 1 << 63 else None, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids)]
    of = spark.createDataFrame(rows, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(of), F.col("cluster") == F.col("number")).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
g AS (
  SELECT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
h AS (
  SELECT p.doc_id, p.s, p.k, g.item_id
  FROM (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS gram
        FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS s FROM d, k)) p
  JOIN g ON g.gram = p.gram AND g.k = p.k),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM (SELECT DISTINCT doc_id, s, k FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP5_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t(rhost, rpath, rverdict)),
m AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.rverdict, row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)),
j AS (SELECT * FROM m WHERE k = 1),
l AS (SELECT DISTINCT host FROM j WHERE rverdict = 'block')
SELECT page_id, host, path, rule, coalesce(rverdict, CASE WHEN host IN (SELECT host FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
c AS (SELECT source, line, count(*) AS n, count(DISTINCT text) AS texts FROM (SELECT source, doc_id, text, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) AS line FROM d) WHERE line <> '' GROUP BY ALL),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (SELECT c.source, list(line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE texts >= 2 AND n > 0.08 * pages GROUP BY c.source),
k AS (SELECT doc_id, d.source, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(b.bad, []), trim(x, ' '))) AS kept FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256 FROM k
"""


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _license_sql() -> str:
    """Places by comparing slices, and templates by comparing every window of twice a template's words: of its distinct words
    85 % at least, rounded up to whole words."""
    lists = [(label, "[" + ", ".join(f"'{w}'" for w in phrase.split()) + "]", len(phrase.split())) for phrase, label in PHRASES]
    places = ", ".join(f"list_transform(list_filter(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: w[i:i + {n - 1}] = {words}), lambda i: {{'pos': i - 1, 'label': '{label}'}})" for label, words, n in lists)
    templates = ", ".join(f"('{label}', '{t}')" for label, t in TEMPLATES)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {_WORDS.format('text')} AS w FROM documents),
p AS (SELECT r, doc_id, len(w) AS n, flatten([{places}]) AS p FROM d),
v AS (SELECT label, string_split(notice, ' ') AS words FROM (VALUES {templates}) AS t(label, notice)),
t AS (SELECT label, list_distinct(words) AS tokens, CAST(ceil(len(list_distinct(words)) * 85 / 100) AS BIGINT) AS need, 2 * len(words) AS span FROM v),
a AS (SELECT r, w, label, tokens, need, span, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(tokens, w[i]))) AS i FROM d, t WHERE len(list_intersect(list_distinct(w), tokens)) >= need),
k AS (SELECT r, label, tokens, need, len(list_intersect(list_distinct(w[i:i + span - 1]), tokens)) AS n FROM a),
g AS (SELECT r, max(n / len(tokens)) AS best, list(DISTINCT label) AS more FROM k WHERE n >= need GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(list_transform(p, lambda x: x.pos)) AS BIGINT) AS first_word, CAST(list_max(list_transform(p, lambda x: x.pos)) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM p LEFT JOIN g USING (r)"""


OP4_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.a = v.vec_id
"""


_WHOLE = """w AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_FLOOR = "CAST(floor(CAST(sum({0}) AS DOUBLE) / count(*)) AS BIGINT)"


def _lloyd(x: str, start: str, rounds: int) -> str:
    """Rounds of assignment (aN: id, g, c, d) and new centres (cN: g, c, e) by plain comparison of all pairs, as common table expressions.

    ``x`` has (g, id, v), ``start`` (g, c, e); g is the part position, or one value.
    """
    out, centre = [], start
    for i in range(rounds + 1):
        out.append(f"p{i} AS (SELECT x.g, x.id, x.v, c.c, CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.e[i]) * (x.v[i] - c.e[i]))) AS BIGINT) AS d FROM {x} x JOIN {centre} c ON x.g = c.g)")
        out.append(f"a{i} AS MATERIALIZED (SELECT g, id, v, c, d FROM p{i} QUALIFY row_number() OVER (PARTITION BY g, id ORDER BY d, c) = 1)")
        if i < rounds:
            out.append(f"m{i} AS (SELECT g, c, list(m ORDER BY k) AS e FROM (SELECT g, c, k, {_FLOOR.format('y')} AS m FROM (SELECT g, c, unnest(v) AS y, unnest(range(1, len(v) + 1)) AS k FROM a{i}) GROUP BY ALL) GROUP BY ALL)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.g, c.c, coalesce(m.e, c.e) AS e FROM {centre} c LEFT JOIN m{i} m ON m.g = c.g AND m.c = c.c)")
            centre = f"c{i + 1}"
    return ",\n".join(out)


OP11_SQL = f"""WITH {_WHOLE},
x AS (SELECT p AS g, vec_id AS id, x[p * 4 + 1:p * 4 + 4] AS v FROM w, range(16) AS r(p)),
c0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS c, v AS e FROM x QUALIFY row_number() OVER (PARTITION BY g ORDER BY id) <= 64),
{_lloyd("x", "c0", 2)},
k AS (SELECT id, string_agg(lpad(lower(to_hex(c)), 2, '0'), '' ORDER BY g) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY id),
s AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY g, c)) AS codebooks_sha256 FROM c2)
SELECT k.id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY w.label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN w ON w.vec_id = k.id, s"""

OP13_SQL = f"""WITH {_WHOLE},
x AS (SELECT 0 AS g, vec_id AS id, x AS v FROM w WHERE len(x) = 64),
c0 AS (SELECT g, row_number() OVER (ORDER BY sha256('2:' || id)) - 1 AS c, v AS e FROM x QUALIFY row_number() OVER (ORDER BY sha256('2:' || id)) <= 40),
{_lloyd("x", "c0", 5)}
SELECT id AS vec_id, CAST(a5.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a5.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.e, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.c = a5.c"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_secret_scan, op3_license_scan, op4_embedding_dedup, op5_url_filter, op6_toxicity, op7_bpe, op8_simhash, op9_line_dedup, op10_token_shards, op11_vector_codes, op12_neighbours, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op3_license_scan": _license_sql(), "op4_embedding_dedup": OP4_SQL, "op5_url_filter": OP5_SQL, "op9_line_dedup": OP9_SQL, "op11_vector_codes": OP11_SQL, "op13_centroids": OP13_SQL}
