"""Vector code compression: a codebook for each part of the vectors, found by partial-distance search.

For a part, dimensions are taken in the order of descending variance of its codebook. The entry that is nearest in the first
dimension is compared whole, which gives the best complete distance so far; then the other dimensions are added one after another
for all entries at once, and a mask drops the entries whose sum strictly exceeds the best complete distance. What is left after the
last dimension is complete, so ties are kept and the smaller number wins. All arithmetic is in integers.

A round is one pass over the written vectors; each task adds up its own rows, so a row per entry and task is shuffled, and the
driver holds the codebooks only, whose size is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.llm.shared import drop_table, written
from tallystream.llm.whole_vectors import finite, matrix, summed, whole_vectors

#: Rows that are searched at once.
STEP = 4096
#: A group of more than this share of the rows is joined by a broadcast of its total: fewer than 10,000 groups.
HOT_SHARE = 0.0001


class Codebook:
    """The entries of one part; ``added`` counts the terms of distances that were computed."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        mean = entries.astype(np.float64).mean(axis=0)
        self.order = np.argsort(-((entries - mean) ** 2).mean(axis=0), kind="stable")
        self.added = 0

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest entry of each row, the smaller number on ties."""
        first, *others = self.order
        partial = (x[:, first, None] - self.entries[None, :, first]) ** 2
        guess = partial.argmin(axis=1)
        best = ((x - self.entries[guess]) ** 2).sum(axis=1)
        row, entry = np.nonzero(partial <= best[:, None])
        total = partial[row, entry]
        self.added += partial.size + x.size
        for d in others:
            total = total + (x[row, d] - self.entries[entry, d]) ** 2
            self.added += len(row)
            near = total <= best[row]
            row, entry, total = row[near], entry[near], total[near]
        starts = np.searchsorted(row, np.arange(len(x)))  # the guess is left for each row
        best = np.minimum.reduceat(total, starts) if len(x) else best
        hit = np.flatnonzero(total == best[row])
        _, at = np.unique(row[hit], return_index=True)
        return entry[hit[at]], best


@dataclass(frozen=True)
class Compressed:
    """``rows`` (id, label, code: one byte a part, error), a written table, and the codebooks by part, entry and component."""

    rows: DataFrame
    codebooks: list[list[list[int]]]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.codebooks for entry in part for v in entry).encode()).hexdigest()


def _pieces(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, int, np.ndarray]]:
    column = batch.column(batch.schema.get_field_index("whole"))
    for start in range(0, batch.num_rows, STEP):
        yield start, min(STEP, batch.num_rows - start), matrix(column.slice(start, STEP), dim)


def _books(codebooks: list[list[list[int]]]) -> list[Codebook]:
    return [Codebook(np.array(part, dtype=np.int64)) for part in codebooks]


def _sums(codebooks: list[list[list[int]]], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(codebooks)
        width, entries = dim // len(books), len(codebooks[0])
        n, sums = np.zeros((len(books), entries), dtype=np.int64), np.zeros((len(books), entries, width), dtype=np.int64)
        for batch in batches:
            for _, _, x in _pieces(batch, dim):
                for p, book in enumerate(books):
                    part = x[:, p * width : (p + 1) * width]
                    code, _ = book.search(part)
                    n[p] += np.bincount(code, minlength=entries)
                    sums[p] += summed(part, code, entries)
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _encode(codebooks: list[list[list[int]]], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(codebooks)
        width = dim // len(books)
        for batch in batches:
            for start, n, x in _pieces(batch, dim):
                found = [book.search(x[:, p * width : (p + 1) * width]) for p, book in enumerate(books)]
                codes = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
                error = np.sum([distance for _, distance in found], axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return run


def compress_vectors(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, *, dim: int | None = None, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> Compressed:
    """Code the vectors as whole numbers floor(256 x), cut into ``parts`` equal consecutive parts.

    The codebook of a part starts as that part of the ``entries`` vectors (all, if fewer; at most 256) of the smallest keys; on
    equal keys the smaller vector comes first, and null keys come last. Each round assigns every part to the nearest entry
    (squared distance; the smaller number on ties), then replaces each used entry by the floor of its parts' mean. A last
    assignment gives the codes and their errors, a row per vector kept; repeated rows are rows of their own. Vectors have ``dim``
    components, or else as many as the first one in the order of keys that ``parts`` divides. Left out: vectors that are null,
    have another length, null or non-finite components, or components whose distances would not fit a long (beyond about 740,000
    at 64). Null keys and labels stay null. Other columns are not read. An empty table gives no rows and no codebooks.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("a code is one byte, and there is at least one part")
    spark, order = rows.sparkSession, [F.asc_nulls_last(key), F.col(vector)]
    if dim is None:
        size = F.size(vector)
        found = rows.filter(finite(F.col(vector)) & (size > 0) & (size % parts == 0)).orderBy(*order).select(size).limit(1).collect()
        dim = found[0][0] if found else parts
    if dim % parts:
        raise ValueError("parts are equal")
    whole = whole_vectors(rows, vector, dim, {"id": key, "label": label})
    kinds = f"id {whole.schema['id'].dataType.simpleString()}, label {whole.schema['label'].dataType.simpleString()}"
    starts = [r["whole"] for r in whole.orderBy(F.asc_nulls_last("id"), "whole").limit(entries).collect()]  # a row per entry
    if not starts:
        return Compressed(spark.createDataFrame([], f"{kinds}, code binary, error long"), [])
    width = dim // parts
    codebooks = [[list(s[p * width : (p + 1) * width]) for s in starts] for p in range(parts)]
    table = written(whole, "whole-vectors")
    for _ in range(rounds):
        sums = table.select("whole").mapInArrow(_sums(codebooks, dim), "part int, entry int, n long, sums array<long>")
        found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()  # a row per entry
        for r in found:
            codebooks[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    out = written(table.mapInArrow(_encode(codebooks, dim), f"{kinds}, code binary, error long"), "codes")
    drop_table(table)
    return Compressed(out, codebooks)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the errors of all rows of a label, of null labels together; null where it does not fit a long.

    Errors are added up before they are shuffled. Totals of labels with many rows are broadcast, fewer than 1 / ``HOT_SHARE`` of
    them; those of other labels are joined on the label.
    """
    totals = written(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    least = HOT_SHARE * (totals.agg(F.sum("n")).first()[0] or 0)
    hot = totals.filter(F.col("n") > least).select(F.col("label").alias("hot"), F.col("label_error").alias("hot_error"))
    marked = coded.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), F.col("label").eqNullSafe(F.col("hot")), "left")
    first = marked.filter("is_hot").select(*coded.columns, F.col("hot_error").alias("label_error"))
    if not totals.filter(F.col("n") <= least).limit(1).count():
        return first
    cold = totals.filter(F.col("n") <= least).select(F.col("label").alias("cold"), "label_error")
    rest = marked.filter("is_hot is null").select(*coded.columns)
    return first.unionByName(rest.join(cold, F.col("label").eqNullSafe(F.col("cold"))).select(*coded.columns, "label_error"))
