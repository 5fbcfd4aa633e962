"""Training-order materialisation of token sequences as fixed-stride binary shards.

Documents are cut into sequences of equally many tokens, and the sequences are numbered 0 .. n-1 in the order of files and of rows
in them, which stays the same however a cluster cuts and deals the files; what is no scan of Parquet files is first written in the
order of key and text. A
keyed Feistel permutation with cycle-walking maps these numbers one to one onto themselves: the permuted number is the
sequence's global slot, so it follows from the number, n and the seed alone. Slots are dealt to shards by ranges of equal size,
and each shard is written as records of one size; slot s is record s mod r of shard s div r. A reader seeks to any slot and
goes on from there.

The texts are encoded twice, once to count the sequences and once to write them, which takes less room than to store the ids
in between; the second run checks itself against the first.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.llm.bpe import codec
from tallystream.llm.shared import written

#: Tokens of a sequence, sequences of a shard, and the id that fills up a last sequence.
LENGTH, SHARD_NUMBERS, PAD = 512, 16384, 50256
#: Bytes of text that are encoded at a time (a longer text is one piece).
PIECE = 1 << 24
#: Characters that Python takes for white space and that other libraries may not.
_SEPARATORS = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85"]


def feistel(index: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """The slots (0 .. n-1) of the indexes: a permutation of the next power of four, walked until it is inside."""
    if n <= 1:
        return np.zeros(len(index), dtype=np.int64)
    half = max(1, math.ceil((n - 1).bit_length() / 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(rounds):
            with np.errstate(over="ignore"):
                z = (right + np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


class WordEncoder:
    """Encodes many texts at a time, and each of their words once.

    A text is cut before each space that follows another kind of character: there a match of the splitting pattern ends in
    any text, so the parts' ids are those of the text. The distinct words of all texts are encoded in one go, each after a
    space, and told apart by the bytes of their tokens. A text where a space follows white space is encoded by itself.
    """

    def __init__(self):
        self.codec = codec()
        if len(self.codec.tokens) > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.direct = self.codec.encoding.encode_to_numpy

    def encode(self, text: str) -> bytes:
        """Ids (little-endian 16-bit) of one text."""
        return self.encode_all(pa.array([text]))[0].tobytes()

    def _entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(parts, at, ids, ends): text i is the entries at[parts[i]:parts[i + 1]], entry k has ids[ends[k]:ends[k + 1]]."""
        split = pc.split_pattern(texts, " ")
        parts = split.offsets.to_numpy().astype(np.int64)
        parts -= parts[0]
        coded = split.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        # A part that is empty or ends with white space is no sure boundary, unless it is a text's last one.
        last = pc.utf8_slice_codeunits(words, -1)
        odd = pc.or_(pc.or_(pc.utf8_is_space(last), pc.equal(last, "")), pc.is_in(last, pa.array(_SEPARATORS))).to_numpy(zero_copy_only=False)
        loose = odd[at]
        loose[parts[1:] - 1] = False
        seen = np.concatenate([[0], np.cumsum(loose)])
        plain = seen[parts[1:]] == seen[parts[:-1]]

        good = words.filter(pa.array(~odd))
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(good)], pa.int32()), good), " ")[0].as_py() if len(good) else ""
        ids = [self.direct(" " + whole)] if len(good) else []
        sizes = np.zeros(len(words), dtype=np.int64)
        if len(good):
            tokens = np.cumsum(self.codec.widths[ids[0]])
            stops = np.searchsorted(tokens, np.cumsum(pc.binary_length(good).to_numpy().astype(np.int64) + 1)) + 1
            sizes[~odd] = np.diff(stops, prepend=0)
        order = np.flatnonzero(~odd)
        # Then come the odd ones, each text's first part or, where it has loose parts, the whole text, and one without ids.
        extra = [" " + words[int(i)].as_py() for i in np.flatnonzero(odd)]
        extra += [words[int(at[h])].as_py() if ok else texts[i].as_py() for i, (h, ok) in enumerate(zip(parts[:-1], plain, strict=True))]
        made = [self.direct(t) if t else np.zeros(0, dtype=np.uint32) for t in extra]
        entry = np.empty(len(words), dtype=np.int64)
        entry[order], entry[odd] = np.arange(len(order)), len(order) + np.arange(int(odd.sum()))
        ends = np.concatenate([[0], np.cumsum(np.concatenate([sizes[order], np.array([len(m) for m in made], dtype=np.int64), [0]]))])
        at = entry[at]
        at[~plain[np.repeat(np.arange(len(plain)), np.diff(parts))]] = len(ends) - 2
        at[parts[:-1]] = len(words) + np.arange(len(plain))
        return parts, at, np.concatenate([*ids, *made, np.zeros(0)]).astype("<u2"), ends

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text, without nulls."""
        parts, at, _, ends = self._entries(texts)
        return np.diff(np.concatenate([[0], np.cumsum(np.diff(ends)[at])])[parts])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of many texts, without nulls: text i has the ids from ends[i] up to ends[i + 1]."""
        parts, at, ids, ends = self._entries(texts)
        taken = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(2 * ends), pa.py_buffer(ids)]).take(pa.array(at))
        stops = np.frombuffer(taken.buffers()[1], dtype="<i8")[taken.offset : taken.offset + len(taken) + 1]
        return np.frombuffer(taken.buffers()[2] or b"", dtype="<u2")[: stops[-1] // 2], stops[parts] // 2


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of rows of about ``PIECE`` bytes; nulls are empty."""
    texts = pc.fill_null(batch.column(column), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(sizes // PIECE, prepend=0)) if len(sizes) else []
    for begin, end in pairwise(sorted({0, *(int(c) for c in cuts), batch.num_rows})):
        yield begin, texts.slice(begin, end - begin)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(file, number of the first row in it, rows) of the runs of a batch that follow one another in a file."""
    if not batch.num_rows:
        return
    files, rows = pc.dictionary_encode(batch.column(2)), batch.column(3).to_numpy()
    cuts = np.flatnonzero((np.diff(files.indices.to_numpy()) != 0) | (np.diff(rows) != 1)) + 1
    for begin, end in pairwise([0, *cuts.tolist(), batch.num_rows]):
        yield files[begin].as_py(), int(rows[begin]), batch.slice(begin, end - begin)


def _counts(length: int):
    """Per run of rows of a file that a task reads: the file, its first row, documents and sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, found = WordEncoder(), []
        for batch in batches:
            for file, first, part in _runs(batch):
                if not found or found[-1][0] != file or found[-1][1] + found[-1][2] != first:
                    found.append([file, first, 0, 0])
                found[-1][2] += part.num_rows
                for _, texts in _pieces(part, 1):
                    found[-1][3] += int((-(-encoder.counts(texts) // length)).sum())
        cols = list(zip(*found, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["file", "first", "docs", "numbers"])

    return run


def _sequences(length: int, seed: int, n: int, starts: dict[tuple[str, int], tuple[int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, after, number, left_docs, left = WordEncoder(), None, 0, 0, 0, 0
        changed = RuntimeError("the input must be the same at each reading")
        for whole in batches:
            for own, first, batch in _runs(whole):
                if (own, first) != (file, after):
                    if left_docs or left or (own, first) not in starts:
                        raise changed
                    file, (number, left_docs, left) = own, starts[own, first]
                after, left_docs = first + batch.num_rows, left_docs - batch.num_rows
                for begin, texts in _pieces(batch, 1):
                    ids, ends = encoder.encode_all(texts)
                    counts = -(-np.diff(ends) // length)
                    total = int(counts.sum())
                    slots = feistel(number + np.arange(total), n, seed)
                    number, left = number + total, left - total
                    if left_docs < 0 or left < 0:
                        raise changed
                    rows = np.repeat(np.arange(len(counts)), counts)
                    seqs = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
                    lows = ends[rows] + seqs * length
                    sizes = np.minimum(ends[rows + 1] - lows, length)
                    for low in range(0, total, 4096):
                        here = slice(low, low + 4096)
                        records = np.full((len(rows[here]), length), PAD, dtype="<u2")
                        inside = np.arange(length) < sizes[here, None]
                        records[inside] = ids[(lows[here, None] + np.arange(length))[inside]]
                        data = pa.Array.from_buffers(pa.binary(2 * length), len(records), [None, pa.py_buffer(records)]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(slots[here], pa.int64()), batch.column(0).take(pa.array(begin + rows[here])), pa.array(seqs[here], pa.int32()), pa.array(sizes[here], pa.int32()), data], ["slot", "doc", "seq", "n_tokens", "record"])
        if left_docs or left:
            raise changed

    return run


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; names of schemes that only Hadoop has are those of the same stores."""
    scheme, mark, rest = folder.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest if mark else folder)


def _write(folder: str, per_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        attempt, shard, sink, temp = TaskContext.get().taskAttemptId(), -1, None, ""

        def close() -> None:
            if sink is None:
                return
            sink.close()
            name = f"{root}/shard-{shard:08d}.bin"
            if store.get_file_info(name).type == fs.FileType.NotFound:
                store.move(temp, name)
            else:  # another attempt's file has the same bytes
                store.delete_file(temp)

        for batch in batches:
            shards = batch.column(0).to_numpy() // per_shard
            for begin, end in pairwise([0, *(np.flatnonzero(np.diff(shards)) + 1), batch.num_rows] if batch.num_rows else []):
                if shards[begin] != shard:
                    close()
                    shard, temp = int(shards[begin]), f"{root}/.shard-{int(shards[begin]):08d}.{attempt}"
                    sink = store.open_output_stream(temp)
                sink.write(b"".join(batch.column(4).slice(begin, end - begin).to_pylist()))
            if batch.num_rows:
                digests = [hashlib.md5(r).hexdigest() for r in batch.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digests, pa.string())], ["slot", "doc", "seq", "n_tokens", "md5"])
        close()

    return run


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is columns of a scan of Parquet files, which know the place of a row in its file."""
    node = df._jdf.queryExecution().optimizedPlan()
    if not node.deterministic() or "_metadata" in df.columns:
        return False
    while node.nodeName() == "Project":
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "HadoopFsRelation" in node.relation().getClass().getName() and node.relation().fileFormat().toString().lower() == "parquet"


def _placed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, file, row): every row with its place."""
    source = docs.select(key, text)
    if not _is_scan(source):
        own = F.xxhash64(F.col(text))
        source = written(source.repartitionByRange(F.col(key), own).sortWithinPartitions(F.col(key), own), "token-texts")
    return source.select(key, text, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def write_shards(docs: DataFrame, folder: str, *, length: int = LENGTH, shard_numbers: int = SHARD_NUMBERS, seed: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the shards below ``folder`` (a URI that driver and executors share) and return the manifest.

    One row per sequence: the key, ``seq`` (number within its document), ``slot``, ``shard``, ``position`` in the shard,
    ``n_tokens`` (without filling) and ``md5`` of the record. Records have ``length`` little-endian 16-bit ids, shards
    ``shard_numbers`` records, but for the last. Null and empty texts have no sequences; texts of any length are encoded whole;
    repeated rows have sequences of their own, so equal records do not tie; null keys are kept; without sequences no shard is
    written; other columns are not read. A task that is run again writes the same bytes under the same names. The order is
    that of the files' names and of the rows in them where ``docs`` is columns of a scan of Parquet files, else that of keys and
    xxhash64 of texts: it does not depend on the cluster, its settings, or how files are cut for tasks.
    """
    if sys.byteorder != "little":
        raise RuntimeError("ids are written as they are in memory, which must be little-endian")
    spark = docs.sparkSession
    source = _placed(docs, key, text)
    counts = source.mapInArrow(_counts(length), "file string, first long, docs long, numbers long").collect()  # a row per run of a task
    starts, n = {}, 0
    for r in sorted(counts, key=lambda r: (r["file"], r["first"])):
        starts[r["file"], r["first"]] = (n, r["docs"], r["numbers"])
        n += r["numbers"]
    shards = max(1, -(-n // shard_numbers))
    tasks = min(shards, 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # mostly one shard each
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    kind = docs.schema[key].dataType.simpleString()
    rows = source.mapInArrow(_sequences(length, seed, n, starts), f"slot long, doc {kind}, seq int, n_tokens int, record binary")
    shard = F.floor(F.col("slot") / shard_numbers)
    dealt = rows.repartitionById(tasks, F.floor(shard * tasks / shards).cast("int")).sortWithinPartitions("slot")
    manifest = written(dealt.mapInArrow(_write(folder, shard_numbers), f"slot long, doc {kind}, seq int, n_tokens int, md5 string"), "manifest")
    for left in store.get_file_info(fs.FileSelector(root)):
        if left.base_name.startswith(".shard-"):  # of attempts that were lost
            store.delete_file(left.path)
    return manifest.select(F.col("doc").alias(key), "seq", "slot", shard.cast("long").alias("shard"), F.pmod("slot", F.lit(shard_numbers)).cast("long").alias("position"), "n_tokens", "md5")


def read_slots(folder: str, start: int, stop: int, *, length: int = LENGTH, shard_numbers: int = SHARD_NUMBERS) -> Iterator[np.ndarray]:
    """The records of the slots from ``start`` up to ``stop``, read one after another from there, without a listing."""
    store, root = _store(folder)
    stride = 2 * length
    for shard in range(start // shard_numbers, -(-stop // shard_numbers)):
        low, high = max(start - shard * shard_numbers, 0), min(stop - shard * shard_numbers, shard_numbers)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as file:
            file.seek(low * stride)
            for _ in range(low, high):
                yield np.frombuffer(file.read(stride), dtype="<u2")
