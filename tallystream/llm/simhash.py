"""SimHash near-dedup with vantage-point trees over the fingerprints.

A fingerprint's bits are cut into bands, and each band has a vantage-point tree. A node of a tree has a vantage point and a
branch for every distance to it (differing bits in the band); the leaves are shards. Vantage points are members of their node,
taken from a bounded sample of the data, and a node is divided as long as it is expected to hold more than ``leaf_rows`` of all
rows, so shards grow in number, and not in size, with the corpus. Where a single row of the sample stands for more rows than
that, every leaf is divided further by distances to a few vantage points that all leaves share.

Distances in a band obey the triangle inequality: what lies within r of a query differs from it by at most r in its distance
to every vantage point. A query enters those branches only, and of them those that hold a point within r, which are the shards
whose boundary its neighbourhood overlaps. Of two fingerprints that differ, only the one with a 0 at the first differing bit
looks for the other. If the bands' radii r_b satisfy sum(r_b + 1) > R, then any two fingerprints within R of each other are
within r_b in some band b (pigeonhole), meet in one of its shards, and are compared there: the search is exact. Equal
fingerprints are one node throughout; shards yield stars, never all pairs.

``EXACT`` links 64-bit fingerprints at up to 4 differing bits with bands of 22, 21 and 21 bits and radii 0, 1 and 1. Near copies
of 80 % similarity differ in some ten of 64 bits, where no exact search is cheaper than comparing all; ``WIDE`` has 512 bits,
and trees over bits sampled from them, and finds candidates only. Its bands have more bits in a larger corpus; trees are added
until simulated copies of the similarity, made from the sample by flipping each bit with the chance arccos(2 s / (1 + s)) / pi,
meet in one of them with the chance ``recall``; the radius of 112 is four deviations above the 78 bits in which such copies
differ. Candidates are united into classes, and all documents of a class are then compared by their sets of shingles, so what
is linked has the similarity asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.llm.components import Labels, connected_components, each_group, split_hot
from tallystream.llm.shared import drop_rows, keep_one, written

#: Rows of a shard beyond which it is compared in pairs of blocks.
SHARD_ROWS = 16384
#: Fingerprints of the sample that trees are grown from, about; those of them that are copied to measure recall, at most.
SAMPLE, COPIES = 16384, 2048


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """SplitMix64 of x + salt: further hashes from one."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass(frozen=True)
class Tree:
    """Bits of a band, the radius of its queries, and nodes: the branch of node i for distance d is node first[i] + d, and a leaf
    has first[i] = -1. ``levels`` are the vantage points that all leaves share. Fingerprints are given as rows of words."""

    bits: tuple[int, ...]
    radius: int
    points: np.ndarray
    first: np.ndarray
    levels: np.ndarray

    def codes(self, prints: np.ndarray) -> np.ndarray:
        """The band's bits of every fingerprint as one number."""
        out = np.zeros(len(prints), dtype=np.uint64)
        for i, bit in enumerate(self.bits):
            out |= ((prints[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)) << np.uint64(i)
        return out

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The shard that each code lies in."""
        node, active = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
        while len(active := active[self.first[node[active]] >= 0]):
            at = node[active]
            node[active] = self.first[at] + np.bitwise_count(codes[active] ^ self.points[at])
        for point in self.levels:
            node = node * (len(self.bits) + 1) + np.bitwise_count(codes ^ point)
        return node

    def overlapping(self, codes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, shards) of the other shards that hold a point within the radius, for each row the ones it looks into."""
        found = []
        for flips in range(1, self.radius + 1):
            for places in combinations(range(len(self.bits)), flips):
                rows = np.flatnonzero((codes >> np.uint64(places[0])) & np.uint64(1) == 0)
                shards = self.leaves(codes[rows] ^ np.uint64(sum(1 << p for p in places)))
                other = shards != own[rows]
                found.append((rows[other] << 48) | shards[other])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return both >> 48, both & ((1 << 48) - 1)


def grow(bits: tuple[int, ...], radius: int, sample: np.ndarray, n: int, leaf_rows: int, draw: np.random.Generator) -> Tree:
    """The tree of a band for ``n`` fingerprints of which ``sample`` is a part."""
    tree = Tree(bits, radius, np.zeros(1, dtype=np.uint64), np.full(1, -1), np.zeros(0, dtype=np.uint64))
    codes, share = tree.codes(sample), n / max(1, len(sample))
    points, first, open_nodes = [0], [-1], [(0, np.arange(len(sample)))]
    while open_nodes:
        node, members = open_nodes.pop()
        if len(members) * share <= leaf_rows or not len(members):
            continue
        point = codes[members[draw.integers(len(members))]]
        far = np.bitwise_count(codes[members] ^ point)
        if not far.any():  # one value
            continue
        points[node], first[node] = int(point), len(points)
        points += [0] * (len(bits) + 1)
        first += [-1] * (len(bits) + 1)
        open_nodes += [(first[node] + int(d), members[far == d]) for d in np.unique(far)]
    more = max(0, math.ceil(math.log(share / leaf_rows) / math.log(8))) if len(sample) and share > leaf_rows else 0
    levels = draw.choice(codes, more) if more else np.zeros(0, dtype=np.uint64)
    return Tree(bits, radius, np.array(points, dtype=np.uint64), np.array(first, dtype=np.int64), levels)


@dataclass(frozen=True)
class Forest:
    """Width of the fingerprint in words of 64 bits, differing bits up to which fingerprints link, and the trees."""

    words: int
    radius: int
    trees: tuple[Tree, ...]

    def shards(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, shard, home): each row's own shard in every tree, and those that its query enters besides."""
        for b, tree in enumerate(self.trees):
            codes, start = tree.codes(prints), np.int64(b) << 48
            own = tree.leaves(codes)
            yield np.arange(len(prints)), start + own, True
            if tree.radius:
                rows, shards = tree.overlapping(codes, own)
                yield rows, start + shards, False


@dataclass(frozen=True)
class Layout:
    """How a forest is made: width in words, differing bits of a link, (bits, radius) of each band, rows of a leaf.

    Without bands these are sampled, for copies of ``similarity`` to meet with the chance ``recall``.
    """

    words: int
    radius: int
    bands: tuple[tuple[tuple[int, ...], int], ...]
    leaf_rows: int
    similarity: float = 1.0
    recall: float = 1.0

    @cached_property
    def flip(self) -> float:
        """The chance that a bit differs between copies of the similarity."""
        return math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi

    def grow(self, sample: np.ndarray, n: int) -> Forest:
        draw = np.random.default_rng(20240)
        if self.bands:
            return Forest(self.words, self.radius, tuple(grow(bits, radius, sample, n, self.leaf_rows, draw) for bits, radius in self.bands))
        width, copied, missed, trees = max(8, math.ceil(math.log2(max(n, 1) / self.leaf_rows))), sample[:COPIES], 1.0, []
        flipped = np.packbits(draw.random((len(copied), 64 * self.words)) < self.flip, axis=1, bitorder="little").view("<u8")
        while missed > 1 - self.recall:
            bits = tuple(sorted(int(b) for b in draw.choice(64 * self.words, width, replace=False)))
            tree = grow(bits, 0, sample, n, self.leaf_rows, draw)
            trees.append(tree)
            meet = (tree.leaves(tree.codes(copied)) == tree.leaves(tree.codes(copied ^ flipped))).mean() if len(copied) else 1.0
            missed *= 1 - min(1.0, max(float(meet), (1 - self.flip) ** width))
        return Forest(self.words, self.radius, tuple(trees))


EXACT = Layout(1, 4, ((tuple(range(22)), 0), (tuple(range(22, 43)), 1), (tuple(range(43, 64)), 1)), 128)
WIDE = Layout(8, 112, (), 256, 0.8, 0.999)
#: Documents of a class, and shingles of all of them together, beyond which it is compared in pairs of blocks.
CLASS_BLOCK, CLASS_GRAMS = 2048, 1 << 22


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle in order.

    A-Z are lower-cased, words are separated by ASCII white space; a text with fewer words than a shingle is one shingle, one
    without words has none.
    """
    import xxhash

    parts = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return np.array([digest(b" ".join(parts), seed)] if parts else [], dtype=np.uint64)
    return np.fromiter((digest(b" ".join(x), seed) for x in zip(*[parts[i:] for i in range(shingle)], strict=False)), dtype=np.uint64, count=len(parts) - shingle + 1)


def simhash(text: str | None, shingle: int, words: int, seed: int = 42) -> bytes:
    """The fingerprint as little-endian words: bit i is set if it is set in over half of the shingles' hashes.

    See ``shingle_hashes``; a text without shingles has the fingerprint zero. The first word of 64 bits is of the shingles'
    XXH64, others of hashes of it.
    """
    return _print(shingle_hashes(text, shingle, seed), words)


def _print(hashes: np.ndarray, words: int) -> bytes:
    if not len(hashes):
        return bytes(8 * words)
    n, out = len(hashes), []
    for w in range(words):
        x = hashes if w == 0 else _mix(hashes, w)
        counts = np.zeros(64, dtype=np.int64)
        for start in range(0, n, 255 * 64):
            bits = np.unpackbits(x[start : start + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255
            if whole:
                counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            counts += bits[whole:].sum(axis=0, dtype=np.uint8)
        out.append(np.packbits(2 * counts > n, bitorder="little").tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, print) for every row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([simhash(t.as_py(), shingle, words) for t in part.column(1)], pa.binary())], [key, "print"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, print binary")


def _rows(prints: pa.ChunkedArray | pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(prints.to_pylist()), dtype="<u8").reshape(-1, words)


def _route(forest: Forest, with_print: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                if not part.num_rows:
                    continue
                nodes, prints = part.column(0), part.column(1)
                for rows, shard, home in forest.shards(_rows(prints, forest.words)):
                    if not len(rows):
                        continue
                    take = pa.array(rows)
                    out = [pa.array(shard, pa.int64())]
                    if with_print:
                        out += [nodes.take(take), prints.take(take), pa.array(np.full(len(rows), home))]
                    yield pa.RecordBatch.from_arrays(out, ["shard", "node", "print", "home"][: len(out)])

    return run


def _compare(forest: Forest):
    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        home = rows["home"].to_numpy(zero_copy_only=False)
        own = np.flatnonzero(home)
        if not len(own) or len(home) < 2:
            return
        nodes, prints = rows["node"].to_numpy(), _rows(rows["print"], forest.words)
        mine, labels = prints[own], Labels(len(nodes))
        step = max(1, (1 << 20) // len(own))
        for start in range(0, len(nodes), step):
            far = np.zeros((len(prints[start : start + step]), len(own)), dtype=np.uint16)
            for w in range(forest.words):
                far += np.bitwise_count(prints[start : start + step, w, None] ^ mine[None, :, w])
            near = far <= forest.radius
            for i in np.flatnonzero(near.sum(axis=1) > home[start : start + step]):  # a row at home is near itself
                rows_near = np.append(own[near[i]], start + i)
                if (labels.label[rows_near] != labels.label[start + i]).any():
                    labels.merge(rows_near)
        a, b = labels.edges(nodes)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return work


def grow_forest(nodes: DataFrame, layout: Layout) -> Forest:
    """The forest for ``nodes`` (print binary), grown from about ``SAMPLE`` of them, those of the smallest hash."""
    n = nodes.count()
    hashed = F.xxhash64(F.lit("sample"), "print")
    some = nodes.select("print").filter(hashed <= F.lit(min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, SAMPLE / max(n, 1)))))).collect()
    return layout.grow(np.frombuffer(b"".join(sorted(bytes(r[0]) for r in some)), dtype="<u8").reshape(-1, layout.words), n)


def link_prints(nodes: DataFrame, layout: Layout, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between ``nodes`` (node long, print binary; each print once) that connect all found within the radius."""
    spark = nodes.sparkSession
    forest = grow_forest(nodes, layout)
    source = nodes.select("node", "print")
    counted = source.mapInArrow(_route(forest, False), "shard long")
    rows = source.mapInArrow(_route(forest, True), "shard long, node long, print binary, home boolean")
    rows = split_hot(rows, "shard", "node", counted, shard_rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(each_group("shard", _compare(forest)), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, layout: Layout = EXACT, *, text: str = "text", key: str = "doc_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per input row: the key, ``print`` and ``component_id``, the smallest key that links reach.

    The key is an integer. Rows that repeat a key are one document. A row with a null key links with nothing and has a null
    component. Null and empty texts have the fingerprint zero and link like any other. Other columns are not read.
    """
    prints = written(fingerprints(docs, shingle, layout.words, text=text, key=key), "prints")
    nodes = written(prints.filter(F.col(key).isNotNull()).groupBy("print").agg(F.min(F.col(key).cast("long")).alias("node")), "nodes")
    links = link_prints(nodes, layout, shard_rows)
    # Rows that repeat a key with different fingerprints: these are linked through the key.
    pairs = prints.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("b"), F.col("print").alias("p"))
    several = pairs.groupBy("b").agg(F.min("p").alias("least"), F.max("p").alias("most")).filter("least <> most").select("b")
    extra = pairs.join(several, "b").join(nodes, F.col("p") == F.col("print")).select(F.col("node").alias("a"), "b")
    parts = connected_components(links.unionByName(extra))
    groups = nodes.join(parts.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(F.col("print").alias("own"), F.coalesce("component", "node").alias("component_id"))
    out = prints.join(groups, F.col("print") == F.col("own"), "left")
    return out.select(key, "print", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def _sketches(shingle: int, words: int):
    """(key, hash, text) to (key, hash, node, print, size): the node is a hash of the set of shingles, 0 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                hashes = [shingle_hashes(t.as_py(), shingle) for t in part.column(2)]
                prints, sets = pa.array([_print(x, words) for x in hashes], pa.binary()), [np.unique(x) for x in hashes]
                own = [pa.array([_set_hash(x) for x in sets], pa.int64()), prints, pa.array([len(x) for x in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *own], ["key", "text_hash", "node", "print", "size"])

    return run


def _set_hash(grams: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes()) | 1).astype(np.int64)) if len(grams) else 0


def _grams(shingle: int):
    """(text, node) of the rows whose set of shingles has that node to (node, grams), the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                grams = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in part.column(0)]
                same = pa.array([_set_hash(g) == n.as_py() for g, n in zip(grams, part.column(1), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([g.tobytes() for g in grams], pa.binary())], ["node", "grams"]).filter(same)

    return run


def _verify(similarity: float):
    """Links of a group of one class that connect all its pairs of at least the similarity (exact Jaccard)."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes, own = rows["node"].to_numpy(), rows["own_block"].to_numpy()
        low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
        sets = [np.frombuffer(g, dtype="<u8") for g in rows["grams"].to_pylist()]
        sizes = np.array([len(g) for g in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark, labels = np.zeros(flat.max() + 1, dtype=bool), Labels(len(nodes))
        for i in np.flatnonzero(own == low):
            other = (labels.label != labels.label[i]) & (own == high) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9)
            if low == high:
                other[: i + 1] = False
            if not other.any():
                continue
            mine = flat[starts[i] : starts[i] + sizes[i]]
            mark[mine] = True
            common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[mine] = False
            near = np.flatnonzero(other & (common >= similarity * (sizes + sizes[i] - common) - 1e-9))
            if len(near):
                labels.merge(np.append(near, i))
        a, b = labels.edges(nodes)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return work


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, layout: Layout = WIDE, *, text: str = "text", key: str = "doc_id", class_block: int = CLASS_BLOCK, class_grams: int = CLASS_GRAMS) -> DataFrame:
    """(key, text_hash, component_id, kept) per row with a key.

    Rows are linked if their sets of shingles have a similarity (Jaccard, exact) of at least ``similarity``, texts of equal sets
    among them. ``component_id`` is the smallest key that links reach, ``kept`` marks the row of that key (of the smallest
    xxhash64 of the text, if it repeats). Rows that repeat a key with unlike texts are not linked by that. Candidates are the
    classes that fingerprints make; all pairs of a class are verified, in pairs of blocks of about ``class_block`` documents and
    ``class_grams`` shingles at most. Null texts and texts without words are one another's copies; a text of any
    length is handled whole (one alone may exceed a block); an empty table gives
    no rows; other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    sketches = written(own.mapInArrow(_sketches(shingle, layout.words), "key long, text_hash long, node long, print binary, size long"), "prints")
    row = F.struct("key", "text_hash")
    nodes = written(sketches.groupBy("node").agg(F.min(row).alias("first"), F.min("print").alias("print"), F.max("size").alias("size")), "nodes")
    classes = written(connected_components(link_prints(nodes.filter("node <> 0"), layout)), "classes")

    wanted = classes.join(nodes.select(F.col("node").alias("n"), "first", "size"), F.col("node") == F.col("n")).select("node", "component", "size", F.col("first.key").alias("k"), F.col("first.text_hash").alias("h"))
    texts = own.join(wanted, (F.col("key") == F.col("k")) & (F.col("text_hash") == F.col("h"))).select("text", "node").mapInArrow(_grams(shingle), "node long, grams binary")
    texts = texts.groupBy(F.col("node").alias("m")).agg(F.min("grams").alias("grams"))  # rows that are wholly alike count once
    sized = wanted.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("n") / class_block).cast("int"), F.ceil(F.col("grams") / class_grams).cast("int"), F.lit(1))
    members = classes.join(sized.select(F.col("component").alias("c"), blocks.alias("s")), F.col("component") == F.col("c")).join(texts, F.col("node") == F.col("m"))
    members = members.withColumn("own_block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("s")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    low, high = F.least("own_block", "other").alias("low"), F.greatest("own_block", "other").alias("high")
    members = members.select(F.xxhash64("component", low, high).alias("at"), low, high, "own_block", "node", "grams")
    links = members.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(each_group("at", _verify(similarity)), "a long, b long")

    groups = written(connected_components(links).withColumnRenamed("node", "member"), "groups")
    named = nodes.select("node", "first").join(groups, F.col("node") == F.col("member"), "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("one"))
    named = named.join(smallest, "component").select(F.col("node").alias("m"), "one")
    out = sketches.join(named, F.col("node") == F.col("m"))
    return out.select("key", "text_hash", F.col("one.key").alias("component_id"), (row == F.col("one")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, layout: Layout = WIDE, *, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of ``near_copies``; rows and columns are otherwise unchanged.

    Rows with a null key stay. A text without a near copy stays, also if its key repeats; of rows that repeat key and text one
    stays.
    """
    found = written(near_copies(docs, similarity, shingle, layout, text=text, key=key), "copies")
    names = found.select(F.col("key"), "text_hash", "kept")
    gone = names.filter(~F.col("kept")).select("key", "text_hash").distinct()
    twice = names.filter("kept").groupBy("key", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select("key", "text_hash")
    return keep_one(drop_rows(docs, gone, key, text), twice, key, text)
