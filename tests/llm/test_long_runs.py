"""Joins of long matches, nodes with very many links, classes of long texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallystream.llm import line_dedup
from tallystream.llm.bpe import TreeCodec, codec
from tallystream.llm.components import _with_least, connected_components
from tallystream.llm.shared import new_path
from tallystream.llm.simhash import near_copies
from tallystream.llm.token_shards import write_shards

RUNS = ["a", "z", "Q", "é", "日", "本", "語", "の", "。", "、", "ह", "ि", "न", "😀", "🧿", "7", "٣", "!", "-", "'", "s", "ll", " ", "\n", "\u3000", "\x1c", "\u180e", "\u0301", "𐐀", "\U0001e900", "the", "ing"]


def with_leaf(leaf):
    tree = TreeCodec.__new__(TreeCodec)
    tree.__dict__ |= codec().__dict__ | {"leaf": leaf}
    return tree


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(RUNS), min_size=1, max_size=4), st.integers(1, 150)), min_size=1, max_size=5), st.integers(16, 200))
def test_long_runs_are_encoded_as_the_plain_ones(parts, leaf):
    text = "".join("".join(own) * n for own, n in parts)
    tree = with_leaf(leaf)
    assert tree.encode(text).tolist() == tree.encoding.encode_ordinary(text)


@pytest.mark.parametrize("alphabet", ["日本語処理入門東京大学", "abcdefgh", "0123456789", "-=+*#", " \n"])
def test_windows_in_one_match_stay_small(alphabet, monkeypatch):
    """A match of 60,000 characters: what is encoded again grows with the number of joins, not with the text at every level."""
    draw = np.random.default_rng(5)
    text = "".join(draw.choice(list(alphabet), 60_000))
    tree, seen = with_leaf(512), []
    leaf, piece = tree._leaf, tree._piece
    monkeypatch.setattr(tree, "_leaf", lambda t: (seen.append(len(t)), leaf(t))[1])
    monkeypatch.setattr(tree, "_piece", lambda d: (seen.append(len(d)), piece(d))[1])
    assert tree.encode(text).tolist() == tree.encoding.encode_ordinary(text)
    assert sum(seen) < 4 * len(text.encode())


def test_every_token_is_merged_from_its_bytes():
    """What the second proof needs of a vocabulary."""
    tokens = codec().tokens
    ranks = {t: i for i, t in enumerate(tokens) if t}
    for token in ranks:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best = min((ranks.get(parts[i] + parts[i + 1], len(tokens)), i) for i in range(len(parts) - 1))
            assert best[0] < len(tokens), token
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("hub", [0, 50_000])
def test_a_hub_is_no_task_of_its_own(spark, hub):
    links = spark.range(1, 20_001).select(F.greatest("id", F.lit(hub)).alias("u"), F.least("id", F.lit(hub)).alias("v")).repartition(8)
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.col("n"), F.min("v")).alias("m"), F.count("*").alias("degree"))
    found = _with_least(both, least, 1000).select("*", F.spark_partition_id().alias("at"))
    tasks = found.filter(F.col("u") == hub).groupBy("at").count().collect()
    assert sum(r["count"] for r in tasks) == 20_000 and max(r["count"] for r in tasks) <= 5_000
    assert found.filter(F.col("m") != F.when(F.col("u") == hub, min(hub, 1)).otherwise(F.least("u", F.lit(hub)))).count() == 0
    parts = connected_components(links.select(F.col("u").alias("a"), F.col("v").alias("b")))
    assert parts.count() == 20_001 and [r.component for r in parts.select("component").distinct().collect()] == [min(hub, 1)]


@pytest.mark.parametrize("grams", [1 << 22, 700])
def test_classes_are_bounded_in_shingles_too(spark, grams):
    words = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(words[:i] + ["other"] + words[i:])) for i in range(12)] + [(50 + i, " ".join(f"{i}x{j}" for j in range(40))) for i in range(3)] + [(90, None), (91, ""), (92, " ")]
    got = {r.key: r.component_id for r in near_copies(spark.createDataFrame(texts, "doc_id long, text string"), class_grams=grams).collect()}
    assert got == {i: 0 for i in range(12)} | {50 + i: 50 + i for i in range(3)} | {90: 90, 91: 90, 92: 90}


@pytest.mark.parametrize("large", [10_000, 2, 1])
def test_pages_of_large_and_small_hosts(spark, large, monkeypatch):
    """The host with two thirds of the pages, small ones and the null host, whichever are broadcast."""
    monkeypatch.setattr(line_dedup, "LARGE_HOSTS", large)
    rows = [(i, h, f"common of {h}\n{'rare' if i % 40 == 0 else 'own'} {i}") for h, n in (("big", 200), ("small", 20), (None, 30), ("one", 1)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {r.host: (r.pages, len(r.bad)) for r in line_dedup.boilerplate_lines(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {"big": (200, 1), "small": (20, 1), None: (30, 1)}


def test_slots_do_not_depend_on_how_files_are_cut(spark, tmp_path):
    """The same files with one split each and with many, and the same rows as no scan in two orders."""
    draw = np.random.default_rng(2)
    rows = [(i, " ".join(map(str, draw.integers(0, 10**9, 60)))) for i in range(900)]
    path = f"{tmp_path}/d"
    for low, high in ((0, 400), (400, 900)):
        spark.createDataFrame(rows[low:high], "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 65536).mode("append").parquet(path)
    before, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("128m", "60k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            docs = spark.read.parquet(path)
            found.append(docs.rdd.getNumPartitions())
            found.append({(r.doc_id, r.seq): r.slot for r in write_shards(docs, new_path(spark, "shards"), length=16).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] < found[2] and found[1] == found[3] and len(found[1]) > 5000
    free = [spark.createDataFrame(part, "doc_id long, text string").repartition(k) for part, k in ((rows, 2), (rows[::-1], 7))]
    one, two = ({(r.doc_id, r.seq): r.slot for r in write_shards(d, new_path(spark, "shards"), length=16).collect()} for d in free)
    assert one == two and len(one) == len(found[1])
