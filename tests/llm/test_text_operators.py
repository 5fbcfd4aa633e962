import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallystream.llm import queries, url_filter
from tallystream.llm.decontaminate import decontaminate, drop_contaminated, remove_spans
from tallystream.llm.license_scan import PHRASES, scan_licenses
from tallystream.llm.line_dedup import drop_boilerplate
from tallystream.llm.secret_scan import scan_secrets
from tallystream.llm.url_filter import Cascade, build_cascade, judge_urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, words string, hash long, source string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def docs(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "extra", i, "s") for i, t in enumerate(texts)], schema)


def brute_windows(text, bench, n=10):
    w, hit, items = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        for s in range(len(b) - min(n, len(b)) + 1) if b else ():
            gram = b[s : s + n]
            for i in range(len(w) - len(gram) + 1):
                if w[i : i + len(gram)] == gram:
                    hit |= set(range(i, i + len(gram)))
                    items |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(items)


BENCH = [(1, "One two, three four FIVE six seven eight nine ten eleven"), (2, "short item"), (10, "Short-item!"), (3, ""), (None, "ten words are here for a null id to be hit"), (4, None)]
TEXTS = [
    "x one two three four five six seven eight nine ten eleven y", "ONE two three four five six seven eight nine TEN", "a short item, and short item", None, "", "é " * 5000 + "short item",
    "one two three four five six seven eight nine", "ten words are here for a null id to be hit", "a short item, and short item", "shortitem", "Él short ITEM É",
]


@pytest.mark.parametrize("bound", [1 << 30, 0])
def test_decontaminate(spark, bound):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontaminate(docs(spark, TEXTS), bench, broadcast_bytes=bound).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found} == {i: brute_windows(t, BENCH) for i, t in enumerate(TEXTS)}


def test_decontaminate_edges(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = spark.createDataFrame([(7, "short item"), (7, "short item"), (7, "clean"), (None, "short item")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_hit) for r in decontaminate(rows, bench).collect()) == [("7", 0), ("7", 2), ("7", 2), ("None", 2)]
    assert decontaminate(rows, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0 and decontaminate(rows.limit(0), bench).count() == 0
    kept = drop_contaminated(rows.withColumn("spans", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "spans"] and [r.text for r in kept.collect()] == ["clean"]
    cut = remove_spans(spark.createDataFrame([(1, "A short item, here."), (2, "clean")], "doc_id long, text string"), bench)
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "A here.", 2: "clean"}


def brute_secrets(text):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_secrets(spark):
    texts = [
        "é password = 'abcdefghijkl' x", "TOKEN:short secret=token:abcdefghijklmnop", "AKIAABCDEFGHIJKLMN and AKIAabc", "0123456789abcdef0", None, "", "id 550e8400-e29b-41d4-a716-446655440000",
        "sha " + "a1" * 20, "key: wJ8r4kQ2zXv7Lp9TnB3cYd6H end", "some_long_identifier_name_here and plain-words-in-a-row", "ſecret=abcdefghijklmn", "x" * 100_000 + " api_key=abcdefghijkl",
    ]
    found = {r.doc_id: r for r in scan_secrets(docs(spark, texts)).collect()}
    line = lambda spans: [f"{s.kind}:{s.start}:{s.end}" for s in spans]
    assert {i: line(r.base) for i, r in found.items()} == {i: brute_secrets(t or "") for i, t in enumerate(texts)}
    extra = {i: [s for s in line(r.spans) if s.startswith("random")] for i, r in found.items()}
    assert extra[8] == ["random:5:29"] and not any(extra[i] for i in (4, 5, 6, 7, 9))
    assert all(set(line(r.base)) <= set(line(r.spans)) for r in found.values())
    assert scan_secrets(docs(spark, texts).limit(0)).count() == 0


def test_licenses(spark):
    texts = [
        "Released under the MIT License. under the mit license", "apache license, version 2", "CC-BY-NC and cc by nc", None, "", "Licensed under the Apache License, Version 2.0.\nother", "under the mit\nlicense",
        "This work is licensed under the GNU General Public License, version 3.", "é under the mit licenseé", "w " * 30_000 + "cc by nc", "This software may be redistributed and used in source and binary",
    ]
    found = {r.doc_id: r for r in scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        places = sorted((s, label) for p, label in PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        assert (found[i].n_words, found[i].places, found[i].base_labels) == (len(w), [s for s, _ in places], sorted({label for _, label in places}))
        assert 0 <= found[i].score <= 1 and set(found[i].base_labels) <= set(found[i].labels)
    assert found[7].labels == ["gpl-3"] and found[7].score == 1.0 and found[10].labels == [] and found[0].labels == ["mit"]
    twice = scan_licenses(docs(spark, [texts[1]]).unionByName(docs(spark, [texts[1]]))).collect()
    assert len(twice) == 2 and twice[0].labels == ["apache-2"]
    assert scan_licenses(docs(spark, texts).limit(0)).count() == 0


def test_urls(spark):
    urls = [
        "http://a.org/x", "https://www.Example.org/es/1?q", "http://example.org/en/12", "http://example.org/en/2", "http://a.com/fr/1", "http://a.com/de/1#t", "http://a.com/en/", None, "no scheme", "http://b.com/en/", "ftp://notexample.org/es/",
        "http://x.net", "http://a.com://de/", "http://é.com?/de/", "http://org", "http://org/", "http://a.com/de/1#t",
    ]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(rows).collect()}
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    expected = {}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = max(((len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
        expected[i] = [host, path, fits[1], fits[2]]
    listed = {h for h, _, _, v in expected.values() if v == "block"}
    assert got == {i: (h, p, r, v or ("block" if h in listed else "allow")) for i, (h, p, r, v) in expected.items()}
    assert judge_urls(rows.limit(0)).count() == 0
    given = {r.host: r.verdict for r in judge_urls(rows, rules=[], listed=spark.createDataFrame([("x.net",), ("x.net",)], "key string")).collect()}
    assert given["x.net"] == "block" and given["a.com"] == "allow"


@pytest.mark.parametrize("bits", [1 << 22, 4096])
def test_cascade_is_exact(spark, bits):
    keys = [(f"host{i}.example", i % 3 == 0) for i in range(3000)]
    rows = spark.createDataFrame(keys, "key string, listed boolean").repartition(4)
    made = build_cascade(rows, bits)
    assert (made.shards > 1) == (bits == 4096) and len(made.levels[0]) > 1
    assert made.mark(rows, "key", "found").filter("found <> listed").count() == 0
    assert Cascade(1, [[]]).mark(rows, "key", "found").filter("found").count() == 0
    assert made.mark(rows, "key", "found", 3 * 4096).filter("found <> listed").count() == 0
    assert made.mark(spark.createDataFrame([(None,)], "key string"), "key", "found").first().found is False


@pytest.mark.parametrize("share", [1, 0])
def test_every_level_is_bounded(spark, share, monkeypatch):
    """Few listed and many unlisted keys: level 1 holds the errors of level 0; too few shards at first are doubled."""
    monkeypatch.setattr(url_filter, "FALSE_SHARE", url_filter.FALSE_SHARE * share)
    rows = spark.range(100_000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") < 10).alias("listed"))
    made = build_cascade(rows, 4096)
    assert made.shards > 1 and max(64 * len(words) for own in made.levels for words in own) <= 4096
    assert made.mark(rows, "key", "found", 20 * 4096).filter("found <> listed").count() == 0


def test_odd_urls(spark):
    """Empty and very long urls; rows and further columns repeat."""
    urls = ["", "http://example.org/es/" + "x" * 200_000, "http://" + "a" * 100_000 + ".com/de/", "http://example.org/es/" + "x" * 200_000]
    rows = spark.createDataFrame([(i % 3, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = sorted((r.page_id, len(r.host), len(r.path), str(r.rule), r.verdict) for r in judge_urls(rows).collect())
    assert got == [(0, 0, 0, "None", "allow"), (0, 11, 200_004, "example.org/es/", "block"), (1, 11, 200_004, "example.org/es/", "block"), (2, 100_004, 4, "com/de/", "block")]


@pytest.mark.parametrize("bound", [200_000, 0])
def test_lines(spark, bound):
    draw = random.Random(5)
    rows = [(i, "\n".join([f"own {i}", *(["  footer "] if i % 2 else []), *(["rare"] if i < 9 else []), "", f"w{draw.random()}"]), ("a" if i % 3 else None)) for i in range(60)] + [(60, None, "a"), (61, "footer\nfooter", "a"), (62, "", "b"), (62, "", "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash"))
    out = drop_boilerplate(table, 0.2, 10, broadcast_rows=bound).collect()
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in out), key=str)
    expected = []
    for i, text, source in rows:
        pages = [t for _, t, s in rows if s == source]
        held = lambda line: sum(line in [x.strip(" ") for x in (t or "").split("\n")] for t in pages)  # noqa: B023, E731
        kept = [x for x in (text or "").split("\n") if not x.strip(" ") or not (held(x.strip(" ")) >= 10 and held(x.strip(" ")) > 0.2 * len(pages))]
        expected.append((i, None if text is None else "\n".join(kept), 0 if text is None else len(text.split("\n")) - len(kept)))
    assert got == sorted(expected, key=str) and any(n for _, _, n in got)
    assert drop_boilerplate(table.limit(0)).count() == 0


def test_digests(spark, tmp_path):
    """The queries derive their digests from the operators' results."""
    docs(spark, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in queries.op1_decontaminate(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        n, hit, items = brute_windows(t, BENCH)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated, got[i].items_sha256) == (n, hit, len(items), hit > 0, hashlib.sha256(",".join(items).encode()).hexdigest())
    secrets = {r.doc_id: r for r in queries.op2_secret_scan(spark, str(tmp_path)).collect()}
    assert all(secrets[i].base_sha256 == hashlib.sha256(",".join(brute_secrets(t or "")).encode()).hexdigest() for i, t in enumerate(TEXTS))


@pytest.mark.parametrize("pages", [5, 20, 60])
def test_boilerplate_of_small_hosts(spark, pages):
    """The ratio decides at every size of a host; lines of copies of one text stay."""
    texts = ["\n".join([*(["footer"] if i < max(2, pages // 5) else []), f"own {i}"]) for i in range(pages)] + ["copied text"] * max(2, pages // 5)
    out = drop_boilerplate(docs(spark, texts)).collect()
    assert {r.doc_id: r.text for r in out} == {i: t.removeprefix("footer\n") for i, t in enumerate(texts)}


def test_secrets_of_one_case(spark):
    lower_key, upper_key, grouped, long = "qzjxkvwpyhgtmbrdnfqxzk", "QZXKVJWPLMHGTBRDNFCYQX", "QZXKV-1234-WJPLM-9876", "wJ8r4kQ2zXv7Lp9TnB3cYd6H"
    texts = [f"key {k} end" for k in (lower_key, upper_key, grouped)] + ["some_long_identifier_name_here and plain-words-in-a-row", f"key {long}/0123456789abcdef/{long} end"]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in scan_secrets(docs(spark, texts)).collect()}
    assert [found[i] for i in range(3)] == [[("random", 4, 4 + len(k))] for k in (lower_key, upper_key, grouped)] and found[3] == []
    assert found[4] == [("random", 4, 29), ("hex", 29, 45), ("random", 45, 70)]


def test_wrapped_licenses(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or"""
    apart = "\n".join(["released", "w " * 40, "under the", "w " * 40, "mit license"])
    found = {r.doc_id: r for r in scan_licenses(docs(spark, [f"before\n{mit}\nafter", f"before\n\n{gpl}\n", apart, mit.replace("\n", " ")])).collect()}
    assert [found[i].labels for i in range(4)] == [["mit"], ["gpl"], [], ["mit"]] and found[0].score == found[1].score == found[3].score == 1.0


def test_license_filters(spark):
    """What each filter of the set join removes, against a comparison of all pairs; each candidate is left once."""
    from tallystream.llm import license_scan as ls

    draw = random.Random(7)
    order = sorted({w for _, t in ls.TEMPLATES for w in t.split()}, key=lambda w: (len(w) % 5, w))
    blocks = [set(draw.sample(order, draw.randrange(1, 40))) for _ in range(400)]
    for i in range(150):  # parts of a template, and some other words
        words_of = sorted(set(ls.TEMPLATES[i % len(ls.TEMPLATES)][1].split()))
        blocks.append(set(draw.sample(words_of, max(1, int(len(words_of) * draw.uniform(0.8, 1))))) | set(draw.sample(order, i % 4)))
    table = [(i, j, w, [x for x in order if x in b]) for i, b in enumerate(blocks) for j, w in enumerate(x for x in order if x in b)]
    rows = spark.createDataFrame(table, "block int, place int, word string, held array<string>")
    index, _ = ls._index(rows, ls.TEMPLATES, 0.85, order)
    joined = rows.join(index, "word").withColumn("t", F.array_join("tokens", " "))
    long_enough = F.size("held") >= F.col("need")
    found = [{(r.block, r.t) for r in part.select("block", "t").collect()} for part in (joined, joined.filter(long_enough), joined.filter(ls._passes(F.col("held"), F.col("place"))))]
    left = joined.filter(ls._passes(F.col("held"), F.col("place"))).select("block", "t")
    wanted = {(i, " ".join(sorted(set(t.split()), key=order.index))) for i, b in enumerate(blocks) for _, t in ls.TEMPLATES if len(b & set(t.split())) >= ls._need(len(set(t.split())), 0.85)}
    everything = len(blocks) * len(ls.TEMPLATES)
    assert wanted <= found[2] < found[1] < found[0] and len(found[0]) < everything and left.count() == len(found[2]) and len(wanted) > 50


def test_wrapped_licenses_agree_with_the_sql(spark, tmp_path):
    import duckdb

    texts = ["before\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files to deal\nin the software without restriction", "Released under\nthe MIT\nlicense", None, "", "x\n" * 2000 + "licensed under the creative\ncommons attribution 4 0\ninternational license", "plain", "released " + "w " * 9 + "\nunder the mit license"]
    docs(spark, [*texts, texts[0]]).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op3_license_scan(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = sorted(con.execute(queries.oracle_sql()["op3_license_scan"]).fetchall(), key=str)
    assert got == wanted and {r[6] for r in got} == {"mit", "", "cc-by,cc-by-nc"}


@pytest.mark.parametrize("bound", [40 * 60, 40 * 5, 40])
def test_hashes_are_broadcast_first(spark, bound):
    """Beyond the bound windows are reduced to those whose hash a document has, by either way, and then broadcast or joined."""
    bench = [*BENCH, *((100 + i, " ".join(f"w{i}x{j}" for j in range(10))) for i in range(40))]
    found = decontaminate(docs(spark, TEXTS), spark.createDataFrame(bench, "item_id long, text string"), broadcast_bytes=bound).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found} == {i: brute_windows(t, bench) for i, t in enumerate(TEXTS)}


def test_long_and_repeated_texts(spark):
    """A very long line, and rows that repeat, for lines and secrets; runs beside many base spans."""
    long = "y " * 300_000
    texts = [f"{long}\nfooter\na", "b\nfooter", "b\nfooter", "c"]
    out = [r.text for r in drop_boilerplate(docs(spark, texts), 0.5).collect()]
    assert sorted(out) == sorted([f"{long}\na", "b", "b", "c"])
    keys = " ".join(f"{'0123456789abcdef' * 2}/QzXkWvPYhgTmBRdnfqxZ{i:04d}" for i in range(3000))
    found = scan_secrets(docs(spark, [keys, keys, None])).collect()
    assert [len(r.base) for r in found] == [3000, 3000, 0] and found[0].spans == found[1].spans and len(found[0].spans) == 6000
