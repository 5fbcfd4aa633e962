"""Connected components of links, and helpers for work on groups that may be large."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.llm.shared import NAMES_ROWS, drop_table, written


#: Links of a node from which it may be hot, and hot nodes at most.
HOT_LINKS, HOT_NODES = 1000, 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _with_least(links: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``links`` (u, v) with m of the node u in ``least`` (n, m, degree); nodes of more than ``most`` links are broadcast."""
    hot = least.filter(F.col("degree") > most).select(F.col("n").alias("hot"), F.col("m").alias("hot_m"))
    marked = links.join(F.broadcast(hot), F.col("u") == F.col("hot"), "left")
    rest = marked.filter("hot is null").join(least.filter(F.col("degree") <= most), F.col("u") == F.col("n")).select("u", "v", "m")
    return marked.filter("hot is not null").select("u", "v", F.col("hot_m").alias("m")).unionByName(rest)


def connected_components(links: DataFrame, hot_links: int = HOT_LINKS, hot_nodes: int = HOT_NODES) -> DataFrame:
    """Label the nodes of ``links`` (a, b: long) with the smallest node that links reach: one row (node, component) per node.

    Large-star and small-star rounds on the shrinking set of links until they are stars. Smallest neighbours are found by
    aggregation and joined back, so no node's neighbours are gathered; each round is a table in the shared folder. A node with
    so many links that at most ``hot_nodes`` nodes can have as many (and ``hot_links`` at least) would be one task of these joins,
    in a large-star round as the smallest node of its links and in a small-star round as the largest: it is broadcast instead. Links of a node with itself are ignored; repeated links count once; no links give no rows.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = written(links.filter("a <> b").select(u, v).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy(F.col("u").alias("n")).agg(F.least(F.col("n"), F.min("v")).alias("m"), F.count("*").alias("degree")), "links")
        most = max(hot_links, 2 * state[0] // hot_nodes)
        large = _with_least(both.filter("v > u"), least, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "links")
        nearest = written(large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"), F.count("*").alias("degree")), "links")
        moved = _with_least(large, nearest, most).filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = written(moved.unionByName(nearest.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        for table in (least, large, nearest, edges):
            drop_table(table)
        edges, before = small, state
        state = _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def each_group(key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], least: int = 2) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over partitions sorted by the long column ``key``: ``work`` gets the rows of one group at a time.

    Groups of fewer than ``least`` rows are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in held) >= least:
                yield from work(pa.Table.from_batches(held))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            if held and keys[0] != last:
                yield from flush()
            if len(cuts) == 2:
                held.append(batch)
            else:
                held.append(batch.slice(0, int(cuts[1])))
                yield from flush()
                sizes = np.diff(cuts)
                for i in np.flatnonzero(sizes[1:-1] >= least) + 1:
                    yield from work(pa.Table.from_batches([batch.slice(int(cuts[i]), int(sizes[i]))]))
                held.append(batch.slice(int(cuts[-2]), int(sizes[-1])))
            last = keys[-1]
        yield from flush()

    return run


class Labels:
    """Union of rows: ``merge`` gives all rows in an index array one label, the smallest of theirs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, rows: np.ndarray) -> None:
        own = np.unique(self.label[rows])
        if len(own) > 1:
            self.label[np.isin(self.label, own)] = own[0]

    def edges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that make up stars: the id of each row and that of the row its label names, where these differ."""
        a, b = ids, ids[self.label]
        return a[a != b], b[a != b]


def split_hot(rows: DataFrame, key: str, ident: str, counted: DataFrame, cap: int) -> DataFrame:
    """Deal groups of more than ``cap`` rows into pairs of blocks, so that any two rows still meet in one group.

    ``counted`` has the column ``key`` for every row (it may be cheaper than ``rows``). The column ``key`` is replaced.
    A group of n rows becomes s(s+1)/2 groups of about 2n/s rows, s = ceil(2n/cap). At most (rows / cap) keys are hot.
    """
    hot = written(counted.groupBy(F.col(key).alias("hot")).agg(F.count("*").alias("n")).filter(F.col("n") > cap), "hot")
    n_hot = hot.count()
    if not n_hot:
        return rows
    table = hot.select("hot", F.ceil(2 * F.col("n") / cap).cast("int").alias("s"))
    joined = rows.join(F.broadcast(table) if n_hot <= NAMES_ROWS else table, F.col(key) == F.col("hot"), "left")
    own = F.pmod(F.xxhash64(F.lit("block"), F.col(ident)), F.col("s")).cast("int")
    other = F.explode(F.when(F.col("s").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("s") - 1)))
    dealt = joined.withColumn("own_block", own).withColumn("other_block", other)
    pair = F.xxhash64(F.col(key), F.least("own_block", "other_block"), F.greatest("own_block", "other_block"))
    return dealt.withColumn(key, F.when(F.col("s").isNull(), F.col(key)).otherwise(pair)).select(*rows.columns)
