"""Benchmark decontamination: word n-grams of test items, looked up in every window of every document.

The windows of the benchmark form a hash set. Documents are scanned once: each window's hash probes the set, and a probe
that succeeds is verified word by word. One marker row a document goes along, so that a single small aggregation by
document gives the result and no document is joined back. The windows are broadcast only after their size was measured. Beyond
the bound they are first reduced to those whose hash some document has: by a broadcast of the hashes alone while these stay
within it, else by a join of the distinct hashes of both sides. Only what then still exceeds the bound is joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.llm.shared import drop_rows, word_array, written

#: Bytes of benchmark windows, or of their hashes alone, up to which they are broadcast; bytes that a hash takes there.
BROADCAST_BYTES, HASH_BYTES = 64 << 20, 40


def benchmark_windows(bench: DataFrame, n: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """One row per distinct window: gram (words), size, hash, and the items (as strings) that hold it.

    An item of fewer than ``n`` words, but not none, is one window. Null ids name no item.
    """
    words = bench.select(F.col(item).cast("string").alias("item"), F.explode(F.array(word_array(F.col(text)))).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(n))
    starts = words.withColumn("size", size).withColumn("start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
    return starts.select("item", "size", F.slice("words", F.col("start"), F.col("size")).alias("gram")).groupBy("gram", "size").agg(F.collect_set("item").alias("items")).withColumn("hash", _by_size(F.col("gram"), F.lit(0), range(1, n + 1)))


def _gram_hash(words: Column, start: Column, size: int) -> Column:
    """The hash of ``size`` words from ``start`` (from 0) on. Single items are read, since slices of long arrays copy them."""
    return F.xxhash64(*[F.get(words, start + i) for i in range(size)])


def _by_size(words: Column, start: Column, sizes: Iterable[int]) -> Column:
    out = F.lit(None).cast("long")
    for size in sizes:
        out = F.when(F.col("size") == size, _gram_hash(words, start, size)).otherwise(out)
    return out


def _covered(hits: Column) -> Column:
    """Words inside any of the (start, size) spans, which are sorted by start."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))

    def add(seen: Column, hit: Column) -> Column:
        end = hit["start"] + hit["size"]
        return F.struct((seen["n"] + F.greatest(F.lit(0), end - F.greatest(hit["start"], seen["end"]))).cast("long").alias("n"), F.greatest(seen["end"], end).alias("end"))

    return F.aggregate(hits, begin, add)["n"]


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 10, *, text: str = "text", key: str = "doc_id", item: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Find every occurrence of a benchmark window in every document.

    Returns per input row of ``docs``: the key, ``text_hash`` (xxhash64 of the text), ``n_words``, ``n_hit`` (words inside
    any occurrence), ``spans`` (array of (start, size) in words, sorted) and ``items`` (ids of the items, as strings, sorted).
    A null or empty text has no words; a text of any length is scanned whole; rows that repeat key and text give as many equal
    rows, rows that repeat a key with another text are judged by themselves; null keys are kept; items that share a window are
    all named, and a word in several occurrences counts once; an empty benchmark or table gives no hits or no rows; other
    columns are not read.
    """
    grams = written(benchmark_windows(bench, n, text, item), "benchmark-windows")
    weight = F.coalesce(F.sum(F.aggregate("gram", F.lit(64).cast("long"), lambda t, w: t + F.octet_length(w) + 24) + 24 * F.size("items")), F.lit(0))
    found = grams.agg(F.count("*"), weight, F.sort_array(F.collect_set("size"))).first()
    sizes = found[2] or []
    base = docs.select(F.col(key), F.xxhash64(F.col(text)).alias("text_hash"), F.explode(F.array(word_array(F.col(text)))).alias("words"))
    # Row 0 of a document is its marker; then come the starts of its windows of the first size, of the second, and so on.
    many = [F.greatest(F.size("words") - size + 1, F.lit(0)) for size in sizes]
    total = sum(many, F.lit(0))
    rows = base.withColumn("at", F.explode(F.sequence(F.lit(0), total)))
    start, width, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for size, here in zip(sizes, many, strict=True):
        inside = (F.col("at") >= before) & (F.col("at") < before + here)
        start, width, before = F.when(inside, F.col("at") - before).otherwise(start), F.when(inside, F.lit(size)).otherwise(width), before + here
    rows = rows.select("*", start.alias("start"), width.alias("size")).withColumn("hash", _by_size(F.col("words"), F.col("start"), sizes))
    small = found[1] <= broadcast_bytes
    if not small:
        hashes, probes = grams.select("hash").distinct(), rows.filter(F.col("at") > 0).select("hash")
        if found[0] * HASH_BYTES <= broadcast_bytes:
            present = probes.join(F.broadcast(hashes), "hash", "left_semi").distinct()
        else:
            present = probes.distinct().join(hashes, "hash", "left_semi")
        grams = written(grams.join(present, "hash", "left_semi"), "windows-present")
        small = grams.agg(weight).first()[0] <= broadcast_bytes
    grams = grams.select(F.col("hash").alias("g_hash"), F.col("gram"), "items")
    if small:
        # The words are compared after the join, not as a part of its key, so that only probes that hit pay for it.
        same = F.slice("words", F.col("start") + 1, F.col("size")) == F.col("gram")
        joined = rows.join(F.broadcast(grams), F.col("hash") == F.col("g_hash"), "left").filter((F.col("at") == 0) | (F.col("gram").isNotNull() & same))
    else:
        # The window's text goes along, but not the whole text.
        keyed = rows.select(key, "text_hash", F.when(F.col("at") == 0, F.size("words")).alias("n"), "at", "hash", "start", "size", F.slice("words", F.col("start") + 1, F.col("size")).alias("own"))
        marks = keyed.filter(F.col("at") == 0).select(key, "text_hash", F.col("n").alias("count"), "at", "start", "size", F.lit(None).cast("array<string>").alias("items"))
        hits = keyed.filter(F.col("at") > 0).join(grams.hint("shuffle_hash"), (F.col("hash") == F.col("g_hash")) & (F.col("own") == F.col("gram")))
        joined = marks.unionByName(hits.select(key, "text_hash", F.lit(None).cast("int").alias("count"), "at", "start", "size", "items"))
    if small:
        joined = joined.select(key, "text_hash", F.when(F.col("at") == 0, F.size("words")).alias("count"), "at", "start", "size", "items")
    hit = F.when(F.col("at") > 0, F.struct("start", "size", "items"))
    per_doc = joined.groupBy(key, "text_hash").agg(F.max("count").cast("long").alias("n_words"), F.count_if(F.col("at") == 0).alias("copies"), F.array_sort(F.collect_set(hit)).alias("hits"))
    out = per_doc.select(
        key, "text_hash", "n_words", F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["size"].alias("size"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return out.select(key, "text_hash", "n_words", _covered(F.col("spans")).alias("n_hit"), "spans", "items")


def drop_contaminated(docs: DataFrame, bench: DataFrame, n: int = 10, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose text holds any benchmark window; rows and columns are otherwise unchanged."""
    bad = decontaminate(docs, bench, n, text=text, key=key).filter("n_hit > 0").select(F.col(key).alias("key"), "text_hash").distinct()
    return drop_rows(docs, written(bad, "contaminated"), key, text)


def remove_spans(docs: DataFrame, bench: DataFrame, n: int = 10, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the hit words cut out of the text; what stands between words stays with the word before it.

    Rows without a hit keep their text as it is.
    """
    found = decontaminate(docs, bench, n, text=text, key=key).filter("n_hit > 0").select(F.col(key).alias("__bad_key"), F.col("text_hash").alias("__bad_hash"), F.col("spans").alias("__spans")).dropDuplicates(["__bad_key", "__bad_hash"])
    joined = docs.join(found, F.col(key).eqNullSafe(F.col("__bad_key")) & (F.xxhash64(F.col(text)) == F.col("__bad_hash")), "left")
    pieces = joined.withColumn("__pieces", F.explode(F.array(F.when(F.col("__spans").isNotNull(), F.regexp_extract_all(F.col(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), 0)))))
    inside = lambda i: F.exists("__spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["size"]))
    kept = F.array_join(F.filter("__pieces", lambda p, i: ~inside(i)), "")
    return pieces.withColumn(text, F.when(F.col("__spans").isNotNull(), kept).otherwise(F.col(text))).select(*docs.columns)
