import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystream.llm import neighbours, queries
from tallystream.llm.centroids import Screen, cluster_vectors, compressed
from tallystream.llm.neighbours import Graph, nearest_neighbours, unit
from tallystream.llm.vector_codes import Codebook, compress_vectors, with_label_error
from tallystream.llm.whole_vectors import bound

SCHEMA = "vec_id long, embedding array<double>, label int"


def whole(x):
    return np.floor(256 * np.asarray(x, dtype=float)).astype(np.int64)


def lloyd(x, centres, rounds):
    centres = [[int(v) for v in c] for c in centres]
    for i in range(rounds + 1):
        d = [[sum((int(a) - b) ** 2 for a, b in zip(row, c)) for c in centres] for row in x]
        near = [row.index(min(row)) for row in d]
        if i < rounds:
            for c in set(near):
                own = [row for row, n in zip(x, near) if n == c]
                centres[c] = [int(sum(int(v) for v in column) // len(own)) for column in zip(*own)]
    return near, [row[n] for row, n in zip(d, near)], centres


def odd_rows(dim):
    """Rows that take no part."""
    return [(900, None, 1), (901, [float("nan")] * dim, 1), (902, [1.0] * (dim - 1) + [float("inf")], 2), (903, [0.5] * (dim - 1) + [None], 2), (904, [1.0] * (dim + 1), 1), (905, [], 1), (906, [1e300] * dim, 3)]


def table(spark, dim, n, seed=1):
    draw = np.random.default_rng(seed)
    x = np.round(draw.standard_normal((n, dim)) + 3 * draw.standard_normal((5, dim))[draw.integers(0, 5, n)], 3)
    rows = [(int(i), [float(v) for v in x[i]], None if i % 7 == 0 else int(i % 3)) for i in range(n)]
    rows += [(i, rows[i][1], 1) for i in (3, 4, 5)] + [(50, rows[9][1], 2), (None, rows[11][1], None), (n, [0.0] * dim, 0)]
    return rows


@pytest.mark.parametrize(("k", "rounds"), [(6, 3), (500, 1), (1, 0)])
def test_clusters(spark, k, rounds):
    rows = table(spark, 8, 150)
    got = cluster_vectors(spark.createDataFrame(rows + odd_rows(8), SCHEMA).withColumn("cluster", F.lit("x")).withColumn("id", F.lit(1)).repartition(5), k, rounds, dim=8)
    mark = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", whole(r[1]).tolist())
    near, distance, centres = lloyd(whole([r[1] for r in rows]), [whole(r[1]) for r in sorted(rows, key=mark)[:k]], rounds)
    assert got.centroids == centres
    expected = sorted(((r[0], c, d) for r, c, d in zip(rows, near, distance, strict=True)), key=str)
    assert sorted((tuple(r) for r in got.rows.select("id", "cluster", "distance").collect()), key=str) == expected


@pytest.mark.parametrize("spread", [1.0, 1e5])
def test_screen_is_exact_and_prunes(spread):
    draw = np.random.default_rng(5)
    x = whole(draw.standard_normal((3000, 64)) * spread)
    c = x[:40].copy()
    c[7] = c[6]  # a tie
    x[100:110] = np.sign(x[100:110]) * bound(64) // 2
    screen = Screen(c.tolist())
    number, distance = screen.nearest(x, *compressed(x))
    brute = np.array([[int(((a - b).astype(object) ** 2).sum()) for b in c] for a in x[:300]])
    assert (number[:300] == brute.argmin(axis=1)).all() and (distance[:300] == brute.min(axis=1)).all()
    assert screen.exact < 3000 * 5  # of 3,000 x 40
    assert screen.nearest(x[:0], *compressed(x[:0]))[0].size == 0


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 9, 2), (2, 256, 1), (8, 1, 0)])
def test_codes(spark, parts, entries, rounds):
    rows = table(spark, 8, 150)
    found = compress_vectors(spark.createDataFrame(rows + odd_rows(8), SCHEMA).withColumn("code", F.lit(1)).repartition(4), parts, entries, rounds)
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, whole(r[1]).tolist()))[:entries]
    width, codes, errors, books = 8 // parts, [], [], []
    for p in range(parts):
        cut = slice(p * width, (p + 1) * width)
        near, distance, book = lloyd(whole([r[1] for r in rows])[:, cut], [whole(r[1])[cut] for r in first], rounds)
        codes.append(near), errors.append(distance), books.append(book)
    assert found.codebooks == books
    expected = [(r[0], r[2], bytes(c), sum(e)) for r, c, e in zip(rows, zip(*codes), zip(*errors))]
    assert sorted((str((r.id, r.label, bytes(r.code), r.error)) for r in found.rows.collect())) == sorted(map(str, expected))
    sums = {label: sum(e for _, own, _, e in expected if own == label) for label in {e[1] for e in expected}}
    assert {(r.label, r.label_error) for r in with_label_error(found.rows).collect()} == set(sums.items())


def test_labels_of_few_rows_are_joined(spark, monkeypatch):
    from tallystream.llm import vector_codes

    rows = spark.range(400).select("id", F.when(F.col("id") % 2 > 0, F.lit(-1)).when(F.col("id") > 20, F.col("id")).alias("label"), F.lit(b"").alias("code"), (F.col("id") * 3).alias("error"))
    sums = {}
    for r in rows.collect():
        sums[r.label] = sums.get(r.label, 0) + r.error
    for share in (0.0001, 0.2):
        monkeypatch.setattr(vector_codes, "HOT_SHARE", share)
        assert {r.id: r.label_error for r in with_label_error(rows).collect()} == {r.id: sums[r.label] for r in rows.collect()}


def test_partial_distances_save_work_and_keep_ties():
    draw = np.random.default_rng(2)
    x, entries = draw.integers(-300, 300, (4000, 8)), draw.integers(-300, 300, (64, 8))
    entries[:, 5] *= 9
    entries[20] = entries[10]
    book = Codebook(entries)
    assert book.order[0] == 5
    code, distance = book.search(x)
    every = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and 20 not in code
    assert book.added < 0.5 * every.size * 8


def test_no_vectors(spark):
    rows = spark.createDataFrame(odd_rows(8), SCHEMA).filter("vec_id <> 904 and vec_id <> 905")
    assert cluster_vectors(rows, dim=8).rows.count() == 0 and cluster_vectors(rows, dim=8).centroids == []
    assert with_label_error(compress_vectors(rows, 4).rows).count() == 0
    some = rows.filter("vec_id in (900, 901)")
    assert nearest_neighbours(some, some).count() == 0 and nearest_neighbours(rows, rows.limit(0)).count() == 0


def brute(rows, queries, k):
    """Cosines of all pairs; a query leaves out one row of its own key and vector."""
    out = []
    for q in queries:
        cosine = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b)))
        rest = list(rows)
        rest.remove(q)
        near = sorted((-round(cosine(q[1], r[1]), 9), r[0] is None, r[0] or 0) for r in rest if len(r[1]) == len(q[1]))
        out += [(q[0], i + 1, None if null else key, -s) for i, (s, null, key) in enumerate(near[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize(("bytes_", "least", "block"), [(1 << 26, 2048, 1 << 18), (4000, 20, 7)])
def test_neighbours_with_copies_and_odd_rows(spark, bytes_, least, block):
    rows = table(spark, 8, 300)[:-1] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.5], 0) for i in range(40)] + [(2000 + i, [1.0 + i, 2.0, 1.0], 0) for i in range(3)] + [(7, table(spark, 8, 300)[7][1], 0)]
    rows = [(r[0], r[1], 0) for r in rows]
    odd = [r for r in odd_rows(8) if r[0] not in (904, 906)] + [(950, [0.0] * 8, 0)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).withColumn("score", F.lit("x")).repartition(3)
    got = nearest_neighbours(frame, frame.filter("vec_id % 3 = 1 or vec_id > 890"), 5, shard_bytes=bytes_, least_rows=least, query_block=block)
    asked = [r for r in rows if r[0] is not None and (r[0] % 3 == 1 or r[0] > 890)]
    assert sorted(str((r.query_id, r["rank"], r.vec_id, round(r.score, 9))) for r in got.collect()) == brute(rows, asked, 5)


def test_one_row_and_huge_numbers(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA)
    assert nearest_neighbours(one, one).count() == 0
    two = spark.createDataFrame([(0, [1e300, 2e300], 1), (1, [1e-300, 2e-300], 1)], SCHEMA)
    assert [(r.query_id, r.vec_id, r["rank"]) for r in nearest_neighbours(two, two).orderBy("query_id").collect()] == [(0, 1, 1), (1, 0, 1)]


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_recall_of_a_shard(kind):
    draw = np.random.default_rng(8)
    x = draw.standard_normal((6000, 64))
    if kind == "clustered":
        x = 0.3 * x + 3 * draw.standard_normal((12, 64))[draw.integers(0, 12, len(x))]
    u = unit(x)
    graph, order = Graph.build(u, 1 - draw.random(len(u)))
    assert sorted(order) == list(range(len(u))) and all(((links >= -1) & (links < n)).all() for links, n in zip(graph.links, graph.sizes, strict=True))
    found = order[graph.search(u[:300], neighbours.SEARCH_BEAM)[:, :6]]
    true = np.argsort(-(u[:300] @ u.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found, true, strict=True)]) >= 0.95


def test_graphs_are_read_back_as_they_were_built(spark):
    draw = np.random.default_rng(4)
    rows = spark.createDataFrame([(int(i), [float(v) for v in draw.standard_normal(16)], 0) for i in range(1500)], SCHEMA)
    asked = rows.filter("vec_id % 50 = 0")
    whole_, parts = (nearest_neighbours(rows, asked, least_rows=n).collect() for n in (5000, 200))
    assert len({(r.query_id, r.vec_id) for r in whole_} & {(r.query_id, r.vec_id) for r in parts}) >= 0.97 * len(whole_) == 0.97 * 150


def test_queries_are_registered():
    assert {"op11_vector_codes", "op12_neighbours", "op13_centroids"} <= set(queries.queries())
