"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph in each shard, shard results merged.

A graph has levels; each holds a random part of the one below, and nodes are numbered by falling level, so a level is a prefix of
the nodes and its links are one flat array of a fixed number of neighbours a node. Levels are filled from the top, in batches that
double: the nodes of a batch look for neighbours in the graph so far, by the beam search that queries use, and among themselves;
links go to neighbours that are nearer to the node than to a neighbour chosen before, then to the nearest others, and back.
Beam searches run for many vectors at once on arrays.

Equal vectors are one node that carries the keys of as many of its rows as an answer can need, so copies crowd no list. Shards are
dealt by a hash. A shard's graph is written as one row a node. Every query visits every shard of its length; a search task
loads one graph, then takes queries batch by batch, so its memory does not grow with them. Similarities of the search are in single
precision; those of results are computed from the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystream.llm.components import each_group
from tallystream.llm.shared import drop_table, written
from tallystream.llm.whole_vectors import finite

#: Neighbours of a node above and on the lowest level; beams of building and searching; nodes expanded at once.
LINKS, LOW_LINKS, BUILD_BEAM, SEARCH_BEAM, EXPAND = 16, 32, 64, 128, 4
#: Nodes linked exactly at first; nodes of a batch at most; queries searched at once.
FIRST, BATCH, QUERIES = 512, 512, 256
#: Bytes of the vectors of a shard, about; nodes of smaller shards, and how many of these are made anyway so that a small table has
#: many tasks; queries of a search task, about; nodes of a beam whose similarities are computed again.
SHARD_BYTES, LEAST_ROWS, LEAST_SHARDS, QUERY_BLOCK, AGAIN = 1 << 26, 2048, 24, 1 << 18, 32


class Graph:
    """Flat neighbour arrays: ``links[level]`` has a row of node numbers, filled up with -1, for each node of the level."""

    def __init__(self, unit: np.ndarray, levels: np.ndarray, links: list[np.ndarray] | None = None):
        self.unit, self.levels = np.ascontiguousarray(unit, dtype=np.float32), levels
        self.sizes = [int((levels >= level).sum()) for level in range(int(levels.max(initial=0)) + 1)]
        self.links = links if links is not None else [np.full((n, LOW_LINKS if level == 0 else LINKS), -1, dtype=np.int32) for level, n in enumerate(self.sizes)]

    @classmethod
    def build(cls, unit: np.ndarray, draws: np.ndarray, beam: int = BUILD_BEAM) -> tuple[Graph, np.ndarray]:
        """The graph of unit vectors with their random numbers in (0, 1], and the order in which it numbers them."""
        levels = np.floor(-np.log(draws) / np.log(LINKS)).astype(np.int64)
        order = np.lexsort((np.arange(len(levels)), -levels))
        graph = cls(unit[order], levels[order])
        for level in reversed(range(len(graph.sizes))):
            graph._fill(level, beam)
        return graph, order

    def _fill(self, level: int, beam: int) -> None:
        links, n = self.links[level], self.sizes[level]
        done = min(n, FIRST)
        if done > 1:
            near = self.unit[:done] @ self.unit[:done].T
            np.fill_diagonal(near, -np.inf)
            width = min(done - 1, beam)
            at = np.argpartition(-near, width - 1, axis=1)[:, :width].astype(np.int32)
            self._connect(level, np.arange(done), at, np.take_along_axis(near, at, axis=1))
        while done < n:
            batch = np.arange(done, min(n, 2 * done, done + BATCH))
            x = self.unit[batch]
            found, near = self._beam(x, level, self._enter(x, level), beam)
            among = x @ x.T
            np.fill_diagonal(among, -np.inf)
            width = min(len(batch) - 1, links.shape[1])
            if width:
                at = np.argpartition(-among, width - 1, axis=1)[:, :width]
                found = np.concatenate([found, batch[at].astype(np.int32)], axis=1)
                near = np.concatenate([near, np.take_along_axis(among, at, axis=1)], axis=1)
            self._connect(level, batch, found, near)
            done = int(batch[-1]) + 1

    def _chosen(self, found: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
        """At most ``width`` of the candidates of each row (-1: none), by the rule of the module's text."""
        order = np.argsort(-near, axis=1, kind="stable")
        found, near = np.take_along_axis(found, order, axis=1), np.take_along_axis(near, order, axis=1)
        x = self.unit[found]
        between = x @ x.transpose(0, 2, 1)
        taken = np.zeros(found.shape, dtype=bool)
        count = np.zeros(len(found), dtype=np.int64)
        cover = np.full(found.shape, -np.inf, dtype=np.float32)  # similarity of each candidate to the nearest one taken
        for j in range(found.shape[1]):
            take = (found[:, j] >= 0) & (near[:, j] > cover[:, j]) & (count < width)
            taken[:, j] = take
            count += take
            np.maximum(cover, np.where(take[:, None], between[:, j, :], -np.inf), out=cover)
        rank = np.where(found < 0, 2, np.where(taken, 0, 1))  # those taken, then the nearest others
        first = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.full((len(found), width), -1, dtype=np.int32)
        out[:, : first.shape[1]] = np.take_along_axis(found, first, axis=1)
        return out

    def _connect(self, level: int, nodes: np.ndarray, found: np.ndarray, near: np.ndarray) -> None:
        links = self.links[level]
        width = links.shape[1]
        for part in np.array_split(np.arange(len(nodes)), -(-len(nodes) // 128)):
            links[nodes[part]] = self._chosen(found[part], near[part], width)
        source = np.repeat(nodes, width).astype(np.int32)
        target = links[nodes].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", self.unit[source], self.unit[target]), target))
        source, target = source[order], target[order]
        own, starts = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(starts, np.diff(np.append(starts, len(target))))
        kept = place < width  # nearest first
        back = np.full((len(own), width), -1, dtype=np.int32)
        back[np.searchsorted(own, target[kept]), place[kept]] = source[kept]
        for part in np.array_split(np.arange(len(own)), -(-len(own) // 128)):
            had, new = links[own[part]], back[part]
            new = np.where((new[:, :, None] == had[:, None, :]).any(axis=2), -1, new)
            both = np.concatenate([had, new], axis=1)
            full = (both >= 0).sum(axis=1) > width
            easy = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :width]
            links[own[part]] = easy
            if full.any():
                both = both[full]
                value = np.where(both >= 0, np.einsum("ij,ikj->ik", self.unit[own[part][full]], self.unit[both]), -np.inf)
                links[own[part][full]] = self._chosen(both, value, width)

    def _enter(self, x: np.ndarray, above: int) -> np.ndarray:
        """Nodes near each row of ``x`` from which a search of level ``above`` starts: the best few of the levels over it."""
        entry = np.zeros((len(x), 1), dtype=np.int32)
        for level in reversed(range(above + 1, len(self.sizes))):
            entry = self._beam(x, level, entry, LINKS)[0][:, :EXPAND]
        return entry

    def _beam(self, x: np.ndarray, level: int, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(node or -1, similarity) of the best nodes found for each row, nearest first."""
        links = self.links[level]
        pool = np.full((len(x), beam), -1, dtype=np.int32)
        near = np.full((len(x), beam), -np.inf, dtype=np.float32)
        fresh = np.zeros((len(x), beam), dtype=bool)
        k = entry.shape[1]
        pool[:, :k] = entry
        near[:, :k] = np.where(entry >= 0, np.einsum("ij,ikj->ik", x, self.unit[entry]), -np.inf)
        fresh[:, :k] = entry >= 0
        live = np.arange(len(x))
        while len(live):
            own, value, open_ = pool[live], near[live], fresh[live]
            at = np.argsort(np.where(open_, -value, np.inf), axis=1, kind="stable")[:, :EXPAND]
            use = np.take_along_axis(open_, at, axis=1)
            np.put_along_axis(open_, at, False, axis=1)
            node = np.where(use, np.take_along_axis(own, at, axis=1), -1)
            new = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(live), -1)
            new = np.sort(new, axis=1)  # repeated ones stand beside each other
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            row, place = np.nonzero(new >= 0)
            close = np.full(new.shape, -np.inf, dtype=np.float32)
            close[row, place] = np.einsum("ij,ij->i", x[live[row]], self.unit[new[row, place]])
            worth = close > value.min(axis=1)[:, None]
            row, place = np.nonzero(worth)
            known = (own[row] == new[row, place][:, None]).any(axis=1)
            close[row[known], place[known]] = -np.inf
            close[~worth] = -np.inf
            width = int((close > -np.inf).sum(axis=1).max(initial=0))
            if width:
                top = np.argsort(-close, axis=1, kind="stable")[:, :width]
                gain = np.take_along_axis(close, top, axis=1)
                own = np.concatenate([own, np.where(gain > -np.inf, np.take_along_axis(new, top, axis=1), -1)], axis=1)
                value = np.concatenate([value, gain], axis=1)
                open_ = np.concatenate([open_, gain > -np.inf], axis=1)
                best = np.argsort(-value, axis=1, kind="stable")[:, :beam]
                own, value, open_ = (np.take_along_axis(a, best, axis=1) for a in (own, value, open_))
            pool[live], near[live], fresh[live] = own, value, open_
            live = live[open_.any(axis=1)]
        return pool, near

    def search(self, x: np.ndarray, beam: int) -> np.ndarray:
        """Nodes near each row of ``x``, as many as the beam has, nearest first; -1 where there are no more."""
        x = np.ascontiguousarray(x, dtype=np.float32)
        return self._beam(x, 0, self._enter(x, 0), beam)[0]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares of very large or small components stay finite; cosines are not changed."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _vectors(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = rows.column(rows.schema.get_field_index("vector"))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _graph_rows(beam: int, names: list[str]):
    """For ``each_group``: the graph of a shard as one row a node, with the node's links of all its levels one after another."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        graph, order = Graph.build(unit(_vectors(rows)), rows["draw"].to_numpy(), beam)
        flat = [[] for _ in order]
        for links in graph.links:
            for node, row in enumerate(links):
                flat[node].append(row)
        links = pa.array([np.concatenate(row) for row in flat], pa.list_(pa.int32()))
        rows = rows.take(pa.array(order)).combine_chunks()
        columns = {"node": pa.array(np.arange(len(order)), pa.int32()), "level": pa.array(graph.levels, pa.int32()), "links": links}
        out = pa.Table.from_arrays([columns[n] if n in columns else rows[n] for n in names], names)
        yield from out.to_batches(max_chunksize=2048)

    return work


def _loaded(batches: list[pa.RecordBatch]) -> tuple[Graph, np.ndarray, list[list]]:
    """(graph, vectors, keys of each node) of a shard's rows in the order of nodes."""
    rows = pa.Table.from_batches(batches)
    vectors, levels = _vectors(rows), rows["level"].to_numpy().astype(np.int64)
    flat = rows["links"].combine_chunks().flatten().to_numpy()
    widths = LOW_LINKS + levels * LINKS
    starts = np.cumsum(widths) - widths
    links = []
    for level in range(int(levels.max(initial=0)) + 1):
        at = starts[: int((levels >= level).sum())] + (LOW_LINKS + (level - 1) * LINKS if level else 0)
        links.append(flat[at[:, None] + np.arange(LINKS if level else LOW_LINKS)])
    return Graph(unit(vectors), levels, links), _scaled(vectors), rows["members"].to_pylist()


def _searched(k: int, beam: int):
    """For mapInArrow over sorted partitions: graphs (kind 0) followed by their queries (kind 1), which are taken batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, at = [], None, None
        for batch in batches:
            spots = batch.column(batch.schema.get_field_index("at")).to_numpy()
            kinds = batch.column(batch.schema.get_field_index("kind")).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(spots) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                if spots[start] != at:
                    held, shard, at = [], None, spots[start]
                part = batch.slice(start, stop - start)
                if kinds[start] == 0:
                    held.append(part)
                    continue
                if held:
                    shard, held = _loaded(held), []
                for first in range(0, part.num_rows if shard else 0, QUERIES):
                    yield _answers(*shard, part.slice(first, QUERIES), k, beam)

    return run


def _answers(graph: Graph, vectors: np.ndarray, members: list[list], queries: pa.RecordBatch, k: int, beam: int) -> pa.RecordBatch:
    """The ``k`` nearest rows of a shard for each query, without the query's own row."""
    x = _vectors(queries)
    nodes = graph.search(unit(x), beam)[:, : max(AGAIN, 4 * k)]
    x = _scaled(x)
    length, own_length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), np.sqrt(np.einsum("ij,ij->i", x, x))
    keys, rows = queries.column(queries.schema.get_field_index("members")).to_pylist(), queries.column(queries.schema.get_field_index("row")).to_pylist()
    out: list[tuple] = []
    for i, found in enumerate(nodes):
        found = found[found >= 0]
        there = vectors[found]
        score = there @ x[i] / (length[found] * own_length[i])
        same = (there == x[i]).all(axis=1)
        near: list[tuple] = []
        for node, value, equal in zip(found.tolist(), score.tolist(), same.tolist(), strict=True):
            ids = list(members[node])
            if equal and keys[i][0] in ids:
                ids.remove(keys[i][0])
            near += [(-value, key is None, key or 0, key) for key in ids]
        out += [(rows[i], keys[i][0], key, -value) for value, _, _, key in sorted(near)[:k]]
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())], ["row", "query_id", "vec_id", "score"])


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, k: int = 5, *, build_beam: int = BUILD_BEAM, beam: int = SEARCH_BEAM, shard_bytes: int = SHARD_BYTES, least_rows: int = LEAST_ROWS, query_block: int = QUERY_BLOCK, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The rows of ``rows`` nearest to each row of ``queries`` by cosine, as far as the graphs find them.

    Returns (query_id, rank from 1, vec_id, score): at most ``k`` rows a query, nearest first, ties to the smaller key, null keys
    last. A query's own row, one of the same key and the same vector, is no candidate; other rows of its key or vector are. The
    score is the cosine in double precision. Vectors that are null or zero, or hold null or non-finite components, take no part;
    vectors of another length are no candidates. Repeated rows are rows of their own, as queries and as candidates. A larger
    ``beam`` finds more. Other columns are not read; no candidates or no queries give no rows.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    valid = finite(F.col(vector)) & F.coalesce(F.exists(F.col(vector), lambda x: x != 0), F.lit(False))
    hashed = lambda name: F.xxhash64(F.lit(name), "vector")
    own = rows.filter(valid).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).withColumn("h", F.xxhash64("vector"))
    # No answer needs more rows of one vector than k and the query's own; the limit also works before the shuffle.
    copies = own.withColumn("n", F.row_number().over(Window.partitionBy("h", "vector").orderBy(F.asc_nulls_last("id")))).filter(F.col("n") <= k + 1)
    members = F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda m: m["id"])
    nodes = written(copies.groupBy("h", "vector").agg(members.alias("members")).withColumn("dim", F.size("vector")), "vectors")
    total = nodes.agg(F.count("*").alias("n"), F.sum(4 * F.col("dim")).alias("bytes")).first()
    shards = max(1, -(-(total["bytes"] or 0) // shard_bytes), min(LEAST_SHARDS, total["n"] // least_rows))
    asked = queries.filter(valid & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    asked = written(asked.withColumn("row", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // query_block))

    spot = (F.col("dim").cast("long") * shards + F.pmod(hashed("shard"), F.lit(shards))).alias("at")
    draw = ((F.shiftrightunsigned(hashed("level"), 11) + 1) / float(1 << 53)).alias("draw")
    kind = nodes.schema["vector"].dataType.simpleString()
    dealt = nodes.select(spot, "members", "vector", draw, hashed("order").alias("order")).repartition(parts, "at").sortWithinPartitions("at", "order")
    names = ["at", "node", "members", "vector", "level", "links"]
    graph = written(dealt.mapInArrow(each_group("at", _graph_rows(build_beam, names), 1), f"at long, node int, members array<long>, vector {kind}, level int, links array<int>"), "graph")
    drop_table(nodes)

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = graph.select("*", numbers(blocks).alias("block")).select((F.col("at") * blocks + F.col("block")).alias("at"), F.lit(0).alias("kind"), "node", "members", "vector", "level", "links", F.lit(0).cast("long").alias("row"))
    right = asked.select("*", numbers(shards).alias("shard"), F.pmod(hashed("block"), F.lit(blocks)).alias("block"))
    right = right.select(((F.size("vector").cast("long") * shards + F.col("shard")) * blocks + F.col("block")).alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("node"), F.array("id").alias("members"), F.col("vector").cast(kind).alias("vector"), F.lit(0).alias("level"), F.array().cast("array<int>").alias("links"), "row")
    both = left.unionByName(right).repartition(parts, "at").sortWithinPartitions("at", "kind", "node")
    found = both.mapInArrow(_searched(k, beam), "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
