"""Embedding near-dedup by sorted projection passes, with an exact way for what passes may miss.

A pass orders the vectors lexicographically by the signs of random projections, concatenated to one number, and compares every
vector with the next ``window`` ones. Ranks come from one range sort of (pass, number, node) without the vectors; blocks of
ranks with a window on both sides make groups of one size, whatever the data. Equal vectors are one node throughout.

How many passes there are follows from the order itself. If a vector and the one ``window`` ranks away share L signs, then all
vectors that share more than L with it lie inside its window, so a pair at the threshold, of which two signs agree with the
probability q = 1 - arccos(cosine) / pi, is found in this pass with at least q^(L+1). The chances of a miss are multiplied for
each vector over the passes. Passes go on while that costs less than to compare the vectors whose chance is still above ``miss``
with all others; those that are left then are compared so, in blocks. L grows with the logarithm of the rows and with
the density around a vector, so neither a large table nor a dense region lowers the recall; the passes grow with about the
power 0.22 of the rows at a cosine of 0.9.

Links of all passes are united into classes. Inside each class all vectors are compared in pairs of bounded blocks, which
yields each vector's number of links: pairs are counted, never emitted. Products are made in single precision; cosines too
close to the threshold for it are computed again in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystream.llm.components import Labels, connected_components, each_group
from tallystream.llm.shared import drop_table, written

#: Signs of a number, ranks of a window and of a block, passes of a round.
BITS, WINDOW, RANKS, ROUND = 48, 512, 4096, 8
#: Chance at most that a pair at the threshold is missed.
MISS = 0.001
#: Vectors of a block of the exact comparison; blocks made anyway, so that a small table also has many tasks; rows of a product.
BLOCK, LEAST_BLOCKS, LEAST_ROWS, STEP = 65536, 8, 512, 128
#: Vectors of a block of a class: at least, at most, and blocks of a class before they grow.
CLASS_LEAST, CLASS_MOST, CLASS_BLOCKS = 512, 8192, 16


def _valid(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, form: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=form).reshape(-1, dim).astype(np.float64)


def _unit(rows: pa.Table, dim: int, form: str) -> np.ndarray:
    x = _matrix(rows["raw"], dim, form)
    x /= np.abs(x).max(axis=1)[:, None]  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1)[:, None]


def _near(x: np.ndarray, y: np.ndarray, cosine: float, low: int = 0, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all cosines of at least ``cosine``, some rows of ``x`` at a time.

    With a ``width``, row i of ``x`` is compared with the rows low + i + 1 to low + i + width of ``y`` only.
    """
    single, other = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
    slack = np.float32((x.shape[1] + 8) * 2.0**-23)  # bound of the error in single precision
    for start in range(0, len(x), STEP):
        stop = min(start + STEP, len(x))
        first, last = (0, len(y)) if width is None else (low + start + 1, min(low + stop + width, len(y)))
        if first >= last:
            continue
        found = single[start:stop] @ other[:, first:last]
        at = np.flatnonzero(found >= np.float32(cosine) - slack)
        i, j = at // (last - first) + start, at % (last - first) + first
        unsure = found.reshape(-1)[at] < np.float32(cosine) + slack
        if width is not None:
            inside = (j > low + i) & (j <= low + i + width)
            i, j, unsure = i[inside], j[inside], unsure[inside]
        unsure = np.flatnonzero(unsure)
        if len(unsure):
            under = np.concatenate([np.einsum("ij,ij->i", x[i[u]], y[j[u]]) < cosine for u in np.array_split(unsure, len(unsure) // 65536 + 1)])
            keep = np.ones(len(i), dtype=bool)
            keep[unsure[under]] = False
            i, j = i[keep], j[keep]
        yield i, j


def _unite(labels: Labels, first: np.ndarray, second: np.ndarray) -> None:
    """Merge the rows ``second`` with their ``first`` ones, which are sorted."""
    for at in np.split(np.arange(len(first)), np.flatnonzero(np.diff(first)) + 1):
        if len(at):
            near = np.append(second[at], first[at[0]])
            if (labels.label[near] != labels.label[near[0]]).any():
                labels.merge(near)


def _keys(start: int, passes: int, bits: int, seed: int, form: str):
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(bits, dtype=np.int64))[::-1]
        for batch in batches:
            nodes, dims = batch.column(0), batch.column(1).to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = _matrix(batch.column(2).take(pa.array(rows)), int(dim), form)
                if int(dim) not in planes:
                    planes[int(dim)] = np.concatenate([np.random.default_rng([seed, int(dim), p]).standard_normal((int(dim), bits)) for p in range(start, start + passes)], axis=1)
                keys = ((x @ planes[int(dim)]) > 0).reshape(len(x), passes, bits).astype(np.int64) @ weights
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), start + p), pa.int32()), pa.array(np.full(len(x), dim), pa.int32()), pa.array(keys[:, p], pa.int64()), nodes.take(pa.array(rows))], ["pass", "dim", "key", "node"])

    return run


def _shared_signs(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Leading signs that two numbers of ``bits`` signs share."""
    return bits - np.frexp((a ^ b).astype(np.float64))[1]


def _compare(cosine: float, window: int, ranks: int, bits: int, form: str):
    """Links of a block of ranks as rows (a, b, 0), and (node, node, log of the chance of a miss) for each of its ranks."""
    agree = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by("rank")
        block, order, nodes, keys = rows["at"][0].as_py(), rows["rank"].to_numpy(), rows["node"].to_numpy(), rows["key"].to_numpy()
        dims, passes, labels = rows["dim"].to_numpy(), rows["pass"].to_numpy(), Labels(len(rows))
        chance = []
        for begin, end in _runs(passes, dims):
            own = order[begin:end] // ranks == block  # the others are windows of the blocks beside it
            low, high = begin + int(np.argmax(own)), begin + len(own) - int(np.argmax(own[::-1]))
            if not own.any():
                continue
            x = _unit(rows.slice(low, end - low), int(dims[begin]), form)
            for i, j in _near(x[: high - low], x, cosine, 0, window):
                _unite(labels, low + i, low + j)
            length = np.full(end - begin, -1, dtype=np.int64)  # without a row ``window`` ranks away the whole side is inside
            if end - begin > window:
                shared = _shared_signs(keys[begin : end - window], keys[begin + window : end], bits)
                length[:-window] = np.maximum(length[:-window], shared)
                length[window:] = np.maximum(length[window:], shared)
            found = np.where(length >= bits, 0.0, agree ** (length + 1.0))[low - begin : high - begin]
            chance.append((nodes[low:high], np.log1p(-np.minimum(found, 1 - 1e-12))))
        a, b = labels.edges(nodes)
        for left, right, value in [(a, b, np.zeros(len(a))), *[(n, n, c) for n, c in chance]]:
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(value, pa.float64())], ["a", "b", "chance"])

    return work


def _runs(passes: np.ndarray, dims: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of rows of one pass and one length."""
    cuts = np.flatnonzero((np.diff(passes) != 0) | (np.diff(dims) != 0)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(passes)], strict=True))


def _against(cosine: float, form: str):
    """Links (a, b) between the vectors of two blocks, those marked ``probe`` and the others."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes, dims, probe = rows["node"].to_numpy(), rows["dim"].to_numpy(), rows["probe"].to_numpy(zero_copy_only=False)
        labels = Labels(len(nodes))
        for dim in np.unique(dims):
            first, second = np.flatnonzero(probe & (dims == dim)), np.flatnonzero(~probe & (dims == dim))
            if not len(first) or not len(second):
                continue
            x, y = _unit(rows.take(pa.array(first)), int(dim), form), _unit(rows.take(pa.array(second)), int(dim), form)
            for i, j in _near(x, y, cosine):
                _unite(labels, first[i], second[j])
        a, b = labels.edges(nodes)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return work


def _count(cosine: float, form: str):
    """(node, links) inside a pair of blocks of one class."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes, copies, dims = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["dim"].to_numpy()
        own, low, high = rows["own_block"].to_numpy(), rows["low"][0].as_py(), rows["high"][0].as_py()
        links = np.zeros(len(nodes))
        for dim in np.unique(dims):
            first, second = np.flatnonzero((own == low) & (dims == dim)), np.flatnonzero((own == high) & (dims == dim))
            if not len(first) or not len(second):
                continue
            x, y = _unit(rows.take(pa.array(first)), int(dim), form), _unit(rows.take(pa.array(second)), int(dim), form)
            for i, j in _near(x, y, cosine):
                if low == high:
                    i, j = i[i != j], j[i != j]
                links += np.bincount(first[i], weights=copies[second[j]], minlength=len(nodes))
                if low != high:
                    links += np.bincount(second[j], weights=copies[first[i]], minlength=len(nodes))
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some], pa.int64()), pa.array(links[some].astype(np.int64))], ["node", "links"])

    return work


def _raw(vectors: DataFrame, form: str) -> DataFrame:
    """(node, copies, vector) with the vector as bytes of its own floating type: (node, copies, dim, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(form)
            ends = np.concatenate([[0], np.cumsum([len(v) for v in lists])])
            raw = [flat[ends[i] : ends[i + 1]].tobytes() for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int32()), pa.array(raw, pa.binary())], ["node", "copies", "dim", "raw"])

    return vectors.select("node", "copies", "vector").mapInArrow(run, "node long, copies long, dim int, raw binary")


def _passes(raw: DataFrame, start: int, passes: int, cosine: float, window: int, ranks: int, bits: int, seed: int, form: str) -> DataFrame:
    """One round of passes: links (a, b, 0) and chances (node, node, log) as a written table."""
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = raw.select("node", "dim", "raw").mapInArrow(_keys(start, passes, bits, seed, form), "pass int, dim int, key long, node long")
    order = ["pass", "dim", "key", "node"]
    placed = written(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()).select("pass", "key", "node", "id"), "order")
    part = F.shiftright("id", 33).cast("int")
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row per partition
    offsets, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(i, 0)
    before = F.element_at(F.lit(offsets) if offsets else F.array(F.lit(0)), part + 1).cast("long")
    ranked = placed.select("pass", "key", "node", (before + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))
    at = F.floor(F.col("rank") / ranks).cast("long")
    inside = F.pmod("rank", F.lit(ranks))
    groups = F.array_compact(F.array(at, F.when(inside >= ranks - window, at + 1), F.when(inside < window, at - 1)))
    vectors = raw.select(F.col("node").alias("n"), "dim", "raw")
    spread = ranked.join(vectors, F.col("node") == F.col("n")).withColumn("at", F.explode(groups)).select("at", "rank", "pass", "key", "dim", "node", "raw")
    out = spread.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(each_group("at", _compare(cosine, window, ranks, bits, form), 1), "a long, b long, chance double")
    out = written(out, "pass-links")
    drop_table(placed)
    return out


def _more_passes(chances: DataFrame, done: int, window: int, miss: float) -> int:
    """How many further passes cost least: each compares a vector with 2 x window others, one left over costs all of them.

    Needs are rounded up to whole rounds, so the driver gets one row per number of rounds.
    """
    need = F.when(F.col("chance") < 0, F.ceil(done * math.log(miss) / F.col("chance") / ROUND)).otherwise(F.lit(float(1 << 40)))
    counts = sorted((int(r["rounds"]), r["n"]) for r in chances.groupBy(F.least(need, F.lit(1 << 40)).cast("long").alias("rounds")).agg(F.count("*").alias("n")).collect())
    left = sum(n for _, n in counts)
    best, cost = 0, None
    for rounds, n in [(done // ROUND, 0), *counts]:
        if rounds >= done // ROUND:
            left = sum(m for r, m in counts if r > rounds)
            here = (rounds * ROUND - done) * 2 * window + left
            if cost is None or here < cost:
                best, cost = rounds * ROUND - done, here
    return best


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _rest(raw: DataFrame, left: DataFrame, n_left: int, block: int, cosine: float, form: str) -> DataFrame:
    """Links between the nodes ``left`` and all nodes: every pair of a block of the one and a block of the other is a group."""
    parts, total = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), raw.count()
    count = lambda n: max(1, -(-n // block), min(LEAST_BLOCKS, n // LEAST_ROWS))
    ours, theirs = count(n_left), count(total)
    place = lambda n: F.pmod(F.xxhash64(F.lit("block"), "node"), F.lit(n)).cast("long")
    one = raw.join(left.select("node"), "node", "left_semi").select(F.lit(True).alias("probe"), place(ours).alias("i"), F.explode(_numbers(theirs)).alias("j"), "node", "dim", "raw")
    other = raw.select(F.lit(False).alias("probe"), F.explode(_numbers(ours)).alias("i"), place(theirs).alias("j"), "node", "dim", "raw")
    groups = one.unionByName(other).select((F.col("i") * theirs + F.col("j")).alias("at"), "probe", "node", "dim", "raw")
    return groups.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(each_group("at", _against(cosine, form)), "a long, b long")


def _find_links(raw: DataFrame, cosine: float, miss: float, block: int, window: int, ranks: int, bits: int, seed: int, form: str) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that connect all pairs found, and the tables they are read from: passes, as many as pay, then the exact
    comparison of what they may miss."""
    if not raw.count():
        return raw.sparkSession.createDataFrame([], "a long, b long"), []
    rounds, chances, done, more = [], None, 0, ROUND
    while more > 0:
        found = _passes(raw, done, ROUND, cosine, window, ranks, bits, seed, form)
        rounds.append(found)
        here = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("chance").alias("chance"))
        if chances is not None:
            here = here.unionByName(chances).groupBy("node").agg(F.sum("chance").alias("chance"))
        before, chances = chances, written(here, "chances")
        if before is not None:
            drop_table(before)
        done, more = done + ROUND, more - ROUND
        if more <= 0:  # planned anew from the chances as they are now
            more = _more_passes(chances, done, window, miss)
    links = rounds[0]
    for found in rounds[1:]:
        links = links.unionByName(found)
    links = links.filter("a <> b").select("a", "b")
    left = chances.filter(~(F.col("chance") <= math.log(miss))).select("node")
    n_left = left.count()
    return links.unionByName(_rest(raw, left, n_left, block, cosine, form)) if n_left else links, [*rounds, chances]


def _through_keys(own: DataFrame, reps: DataFrame, key: str) -> DataFrame:
    """Links (a, b) between the nodes of each key that has several vectors."""
    several = own.groupBy(F.col(key).alias("k")).agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).filter("low <> high").select("k")
    rows = own.join(several, F.col(key) == F.col("k"), "left_semi")
    named = reps.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("vector").alias("rep"), "node")
    of = rows.join(named, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("vector") == F.col("rep"))).select(F.col(key).alias("k"), "node").distinct()
    first = of.groupBy(F.col("k").alias("k2")).agg(F.min("node").alias("b"))
    return of.join(first, F.col("k") == F.col("k2")).filter("node <> b").select(F.col("node").alias("a"), "b")


def embedding_duplicates(
    rows: DataFrame, cosine: float = 0.9, *, miss: float = MISS, exact: bool = False, block: int = BLOCK, window: int = WINDOW, ranks: int = RANKS, bits: int = BITS, seed: int = 7, vector: str = "embedding", key: str = "vec_id"
) -> DataFrame:
    """Link vectors of a cosine of at least ``cosine`` and unite them.

    Returns per input row the key (an integer), ``n_links`` (long: other rows linked directly), ``component_id`` (smallest key
    reachable by links, itself included) and ``kept`` (key = component_id). Vectors that are null or zero, or hold null or
    non-finite components, and rows with a null key, link with nothing; a null key has a null component and is kept. Vectors
    of different lengths do not link. Rows that repeat a key are rows of their own with links of their own, but those whose
    vectors may link share a component; equal vectors are linked. No pair below the threshold is linked. A pair at the threshold is missed with a chance of at most about ``miss`` at
    every size and density; ``exact`` compares all pairs instead. Other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    form = "<f4" if rows.schema[vector].dataType == T.ArrayType(T.FloatType(), rows.schema[vector].dataType.containsNull) else "<f8"
    # Vectors are grouped and joined by two hashes first; equality of the vectors themselves is tested after.
    own = rows.select(F.col(key), F.col(vector).alias("vector"))
    linkable = F.col(key).isNotNull() & _valid(F.col("vector"))
    own = own.withColumn("h1", F.when(linkable, F.xxhash64("vector"))).withColumn("h2", F.when(linkable, F.hash("vector")))
    grouped = own.filter(F.col("h1").isNotNull()).groupBy("h1", "h2", "vector").agg(F.min(F.col(key).cast("long")).alias("first"), F.count("*").alias("copies"))
    # Two vectors may have one smallest key where keys repeat, so nodes are named by key and vector.
    reps = written(grouped.withColumn("node", F.xxhash64("first", "vector")), "vectors")
    raw = written(_raw(reps, form), "raw-vectors")

    links, used = (_rest(raw, raw, raw.count(), block, cosine, form), []) if exact else _find_links(raw, cosine, miss, block, window, ranks, bits, seed, form)
    classes = written(connected_components(links.unionByName(_through_keys(own.filter(F.col("h1").isNotNull()), reps, key))), "classes")
    for table in used:
        drop_table(table)

    sized = classes.groupBy("component").agg(F.count("*").alias("n"))
    size = F.least(F.lit(CLASS_MOST), F.greatest(F.lit(CLASS_LEAST), F.ceil(F.col("n") / CLASS_BLOCKS)))
    blocks = F.greatest(F.ceil(F.col("n") / size).cast("int"), F.lit(1))
    members = classes.join(sized.select(F.col("component").alias("c"), blocks.alias("s")), F.col("component") == F.col("c")).join(raw.select(F.col("node").alias("m"), "copies", "dim", "raw"), F.col("node") == F.col("m"))
    members = members.withColumn("own_block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("s")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    low, high = F.least("own_block", "other").alias("low"), F.greatest("own_block", "other").alias("high")
    members = members.select(F.xxhash64("component", low, high).alias("at"), low, high, "own_block", "node", "copies", "dim", "raw")
    counted = members.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(each_group("at", _count(cosine, form)), "node long, links long").groupBy(F.col("node").alias("counted")).agg(F.sum("links").alias("links"))

    named = reps.join(classes.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").withColumn("component", F.coalesce("component", "node")).drop("member")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = named.join(smallest.withColumnRenamed("component", "c"), F.col("component") == F.col("c")).join(counted, F.col("node") == F.col("counted"), "left")
    final = linked.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("vector").alias("rep"), "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    same = (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("vector") == F.col("rep"))
    component = F.when(F.col(key).isNotNull(), F.coalesce("component_id", F.col(key).cast("long")))
    out = own.join(final, same, "left").select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key).cast("long") == F.col("component_id"), F.lit(True)))
