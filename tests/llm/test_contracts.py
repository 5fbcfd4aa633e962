import time

from pyspark.sql import functions as F

import corpus_pipeline
from tallystream.llm.decontaminate import drop_contaminated
from tallystream.llm.embed_dedup import embedding_duplicates
from tallystream.llm.license_scan import scan_licenses
from tallystream.llm.line_dedup import drop_boilerplate
from tallystream.llm.secret_scan import Scanner
from tallystream.llm.shared import fresh, keep_one


def test_rows_of_one_key_share_a_component(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (3, [1.0, 0.01]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0]), (9, None), (7, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for exact in (False, True):
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_duplicates(df, exact=exact).collect())
        assert got == [(3, 1, 3, True), (5, 0, 3, False), (5, 1, 3, False), (7, 0, 7, True), (9, 0, 9, True), (9, 1, 9, True), (9, 1, 9, True)]


def test_line_breaks_do_not_change_licenses(spark):
    notice = "released under the mit license".split()
    gap = " ".join(["word"] * 2000)
    far = [notice[0], "under", "the mit", "license"]
    texts = [f" {gap} ".join(far), f"\n{gap}\n".join(far), " ".join(notice), "\n".join(notice), "licensed\nunder\ncc\nby nc\n4 0", "licensed under cc by nc 4 0"]
    got = {r.doc_id: (list(r.labels), r.score) for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == got[1] == ([], 0.0) and got[2] == got[3] == (["mit"], 1.0) and got[4] == got[5] == (["cc-by-nc"], 1.0)


def test_many_keys_in_a_text():
    text = " ".join(f"token=Zq9{i:09d}Xk7" for i in range(200_000))
    start = time.process_time()
    base, spans = Scanner().scan(text)
    assert len(base) == 200_000 <= len(spans) and time.process_time() - start < 12
    packed = "/".join(f"{i:016x}" for i in range(40_000))  # one run with very many base spans inside
    start = time.process_time()
    base, _ = Scanner().scan(packed)
    assert len(base) == 40_000 and time.process_time() - start < 6


def test_helper_columns_clash_with_none(spark):
    names = ["__key", "__hash", "__row", "__host", "__bad", "__found", "__kept", "__own_salt", "__salt", "__own_lines", "___key", "key", "text_hash", "k", "h", "row", "n_lines"]
    texts = ["same line\nown a", "same line\nown b", "the quick brown fox jumps over the lazy dog today", None]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumns({n: F.lit(n) for n in names})
    assert fresh(docs) == "____"
    hit = spark.createDataFrame([("i", texts[2])], "item_id string, text string")
    out = drop_contaminated(docs, hit)
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 3] and out.columns == docs.columns
    for rows in (1, 200_000):  # joined, and broadcast
        got = {r.doc_id: r for r in drop_boilerplate(docs, 0.3, broadcast_rows=rows).collect()}
        assert got[0].text == "own a" and got[1].text == "own b" and all(r["__key"] == "__key" and r["__kept"] == "__kept" for r in got.values())
    line = corpus_pipeline.line_dedup(spark, docs, "")
    assert line.columns == docs.columns and {r.n_lines for r in line.collect()} == {"n_lines"}
    twice = docs.unionByName(docs)
    name = twice.filter("doc_id = 1").select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("text_hash")).distinct()
    kept = keep_one(twice, name, "doc_id", "text")
    assert kept.count() == 7 and kept.columns == docs.columns
