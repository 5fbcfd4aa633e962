import hashlib
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tallystream.llm.bpe import TreeCodec, codec, decode_ids, encode_documents
from tallystream.llm.components import connected_components
from tallystream.llm.embed_dedup import embedding_duplicates
from tallystream.llm.shared import new_path
from tallystream.llm.simhash import EXACT, WIDE, drop_near_duplicates, link_prints, near_copies, near_duplicates, simhash
from tallystream.llm.token_shards import WordEncoder, feistel, read_slots, write_shards
from tallystream.llm.toxicity import SeverityModel, drop_toxic, fit_severity, score_severity


def classes(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("hot", [1000, 3])
def test_components(spark, hot):
    draw = random.Random(3)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 380)] + [(500, x) for x in range(501, 560)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), hot).collect()}
    expected = classes(600, links)
    assert all(got[x] == expected[x] for pair in links for x in pair if pair[0] != pair[1])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


PIECES = st.sampled_from(["the", " the", "  ", "\n", " \n ", "'s", "'", "re", "I'll", "é", "ñandú", "日本", "12", "3.14", "\t", "!!", " ", "　x", "a" * 40, "\u001c", " '", "'r", "e", "😀", "\x00"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join), st.integers(1, 9))
def test_tree_encoding_is_the_plain_one(text, leaf):
    import public_tokenizers

    c = codec()
    tree = TreeCodec.__new__(TreeCodec)
    tree.__dict__ |= c.__dict__ | {"leaf": leaf}
    ids = tree.encode(text)
    assert ids.tolist() == c.encoding.encode_ordinary(text) and tree.decode(ids) == text.encode()
    ids_of, ends = WordEncoder().encode_all(pa.array([text, "", text[::-1], text]))
    assert [ids_of[ends[i] : ends[i + 1]].tolist() for i in range(4)] == [c.encoding.encode_ordinary(t) for t in (text, "", text[::-1], text)]
    assert WordEncoder().encode(text) == np.array(c.encoding.encode_ordinary(text), dtype="<u2").tobytes()
    assert public_tokenizers.PATTERN == c.encoding._pat_str


def test_joining_is_associative():
    c, text = codec(), "It's a long-ish text, with  spaces\n and 123 numbers; l'été." * 3
    left = c.join(text, 0, 60, len(text), c.join(text, 0, 23, 60, c.encode(text[:23]), c.encode(text[23:60])), c.encode(text[60:]))
    right = c.join(text, 0, 23, len(text), c.encode(text[:23]), c.join(text, 23, 60, len(text), c.encode(text[23:60]), c.encode(text[60:])))
    assert left.tolist() == right.tolist() == c.encoding.encode_ordinary(text)
    assert c.join(text, 0, 0, len(text), c.encode(""), c.encode(text)).tolist() == left.tolist()


def test_other_patterns_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        TreeCodec(public_tokenizers.path("byte_bpe_50k.tiktoken"), r"\S+|\s+")


def test_encode_documents(spark):
    texts = ["Hello world", None, "", "x" * 50_000, "word " * 40_000, "Hello world", "日本語 のテキスト\n\n"]
    rows = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id or 0: r for r in decode_ids(encode_documents(rows)).collect()}
    for i, t in enumerate(texts):
        raw = np.array(codec().encoding.encode_ordinary(t or ""), dtype="<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(raw) // 4, raw, (t or "").encode())
        assert got[i].ids_sha256 == hashlib.sha256(raw).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_documents(rows.limit(0)).count() == 0


def brute_print(text, k):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    bits = Counter(i for g in grams for i in range(64) if xxhash.xxh64_intdigest(g, 42) >> i & 1)
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(grams))


def corpus(n=120, seed=1):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(80, 300))) for _ in range(n)]
    for i in range(0, n, 6):  # near copies
        w = texts[i].split()
        for _ in range(1 + i % 3):
            w[draw.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    return [*texts, texts[3], texts[3].upper(), "", None, "  \t", "one two", "ONE\x0btwo", "x " * 30_000]


def test_fingerprints_and_classes(spark):
    texts = corpus()
    prints = [brute_print(t, 4) for t in texts]
    assert [int.from_bytes(simhash(t, 4, 1), "little") for t in texts] == prints
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    expected = classes(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    for cap in (16384, 8):
        got = {r.doc_id: r.component_id for r in near_duplicates(rows, shard_rows=cap).collect()}
        assert [got[i] for i in range(len(texts))] == expected


def test_forest_is_exact(spark):
    draw = random.Random(9)
    values = {draw.getrandbits(64) for _ in range(300)}
    for v in list(values)[:150]:
        values.add(v ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 7))))
    values = sorted(values)
    nodes = spark.createDataFrame([(i, v.to_bytes(8, "little")) for i, v in enumerate(values)], "node long, print binary")
    links = [tuple(r) for r in link_prints(nodes, EXACT).collect()]
    wanted = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    assert wanted and classes(len(values), links) == classes(len(values), wanted)


@pytest.mark.parametrize("leaf_rows", [1, 5])
def test_deep_trees_are_exact(spark, leaf_rows):
    """Also where a small sample stands for many rows, so that leaves are divided by shared vantage points."""
    draw = np.random.default_rng(12)
    layout = replace(EXACT, leaf_rows=leaf_rows)
    values = draw.integers(0, 2**64, 3000, dtype=np.uint64)
    for i in range(0, 2000, 2):
        values[i + 1] = values[i] ^ np.uint64(sum(1 << int(b) for b in draw.choice(64, draw.integers(1, 7), replace=False)))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    for sample in (values, values[:40]):
        forest = layout.grow(sample.reshape(-1, 1), len(values))
        homes, visits = {}, []
        for rows, shard, home in forest.shards(values.reshape(-1, 1)):
            for r, s in zip(rows.tolist(), shard.tolist(), strict=True):
                homes.setdefault(s, []).append(r) if home else visits.append((r, s))
        met = np.zeros_like(near)
        for rows in homes.values():
            met[np.ix_(rows, rows)] = True
        for r, s in visits:
            met[r, homes.get(s, [])] = True
        assert (met | met.T)[near].all() and (met.sum() < 0.1 * near.size) and max(len(t.first) for t in forest.trees) > 20
        assert (len(sample) == 40) == any(len(t.levels) for t in forest.trees)


def test_comparisons_do_not_grow_with_the_corpus():
    draw, per_row = np.random.default_rng(2), []
    for n in (20_000, 160_000):
        values = draw.integers(0, 2**64, (n, 1), dtype=np.uint64)
        homes, visits = [], []
        forest = EXACT.grow(values[:16384], n)
        for start in range(0, n, 4096):
            for _, shard, home in forest.shards(values[start : start + 4096]):
                (homes if home else visits).append(shard)
        shards, counts = np.unique(np.concatenate(homes), return_counts=True)
        at = np.searchsorted(shards, found := np.concatenate(visits)).clip(max=len(shards) - 1)
        per_row.append(((counts**2).sum() + counts[at][shards[at] == found].sum()) / n)
    assert per_row[1] < 1.5 * per_row[0] < 0.2 * 20_000


def test_repeated_and_null_keys(spark):
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "quite another text than that one here"), (7, "quite another text than that one here"), (None, "a b c d e f"), (None, None), (9, "zz yy xx ww vv uu tt")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_duplicates(rows).collect())
    assert got == [("5", "5"), ("5", "5"), ("7", "5"), ("9", "9"), ("None", "None"), ("None", "None")]
    kept = drop_near_duplicates(rows.withColumn("row", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "row"] and Counter(r.doc_id for r in kept.collect()) == {5: 2, 9: 1, None: 2}  # a text without a near copy stays
    twice = drop_near_duplicates(rows.union(rows.filter("doc_id = 9")).withColumn("row", F.lit(1)))
    assert twice.columns == ["doc_id", "text", "row"] and Counter(r.doc_id for r in twice.collect()) == {5: 2, 9: 1, None: 2}
    assert drop_near_duplicates(rows.limit(0)).count() == 0


def test_wide_fingerprints_find_near_copies(spark):
    """Pairs of a similarity of 0.8 or more are found with a recall of at least 0.9; unrelated texts stay."""
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, pairs = [], []
    for i in range(150):
        w = [draw.choice(vocabulary) for _ in range(draw.randrange(60, 400))]
        v = list(w)
        for _ in range(max(1, int(len(w) * 0.02 * draw.random()))):
            v[draw.randrange(len(v))] = draw.choice(vocabulary)
        grams = lambda x: {tuple(x[j : j + 5]) for j in range(len(x) - 4)}
        texts += [" ".join(w), " ".join(v)]
        if len(grams(w) & grams(v)) >= 0.8 * len(grams(w) | grams(v)):
            pairs.append((2 * i, 2 * i + 1))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(rows, 5, WIDE).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs) > 100
    assert all(got[i] in (i, i - 1) for i in got)


def test_embeddings(spark):
    draw = np.random.default_rng(6)
    base = draw.normal(size=(150, 16))
    near = base[:60] + 0.25 * draw.normal(size=(60, 16))
    dense = base[0] + 0.05 * draw.normal(size=(40, 16))
    x = np.concatenate([base, near, dense, base[5:6], base[5:6], 3 * base[6:7]]).astype(np.float32)
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    odd = [(900, None, "c"), (901, [0.0] * 16, "c"), (902, [float("nan")] * 16, "c"), (903, [None] + [1.0] * 15, "c"), (904, [float("inf")] + [1.0] * 15, "c"), (905, [1.0, 2.0], "c"), (906, [2.0, 4.0], "c"), (None, x[0].tolist(), "c"), (907, [], "c")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, node string")
    got = {r.vec_id: r for r in embedding_duplicates(table).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    expected = classes(len(x), zip(*map(list, np.nonzero(links)), strict=True))
    recall = sum(got[i].n_links for i in range(len(x))) / links.sum()
    assert recall >= 0.9 and all(got[i].n_links <= links[i].sum() for i in range(len(x)))
    assert np.mean([got[i].component_id == expected[i] for i in range(len(x))]) >= 0.9
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (900, 901, 902, 903, 904, 907))
    assert (got[905].n_links, got[906].component_id, got[None].component_id, got[None].kept) == (1, 905, None, True)
    assert embedding_duplicates(table.limit(0)).count() == 0


def test_severity(spark):
    draw = random.Random(8)
    plain = [f"word{i}x" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [draw.choice(plain) for _ in range(draw.randrange(20, 200))]
        bad = i % 8 == 0
        for _ in range(draw.randrange(1, 9) if bad else 0):
            w[draw.randrange(len(w))] = draw.choice(["vile", "rotten", "grimstoke", "grimsable"])
        rows.append((i, " ".join(w), "c"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None, "c"), (1001, "", "c"), (None, "vile rotten vile", "c")], "doc_id long, text string, severity string")
    model = fit_severity(docs, spark.createDataFrame([x for x in labels if x[0] < 450] + [(None, 1), (3, None)], "doc_id long, toxic int"))
    assert model.thetas[0] < model.thetas[1] < model.thetas[2] and "=vile" in model.weights
    got = {r.doc_id: r for r in score_severity(docs, model).collect()}
    held = [(got[i].toxic, bool(y)) for i, y in labels if i >= 450]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert not got[1000].toxic and not got[1001].toxic and got[None].toxic and got[None].severity > got[1001].severity and 0 <= got[None].severity <= 3
    assert drop_toxic(docs, model).columns == docs.columns and {r.doc_id for r in drop_toxic(docs, model).collect()} == {i for i, r in got.items() if not r.toxic}
    none = fit_severity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none == SeverityModel({}, none.thetas) and drop_toxic(docs, none).count() == docs.count() and drop_toxic(docs.limit(0), model).count() == 0


def test_grades_are_used_and_repeated_rows_stay(spark):
    draw = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        grade = (0, 0, 0, 1, 2, 3)[i % 6]
        w = [f"word{draw.randrange(200)}x" for _ in range(60)]
        for _ in range(3 * grade):
            w[draw.randrange(60)] = "vile"
        rows.append((i, " ".join(w)))
        labels.append((i, grade))
    docs = spark.createDataFrame([*rows, rows[5], (2000, "plain words " * 50_000 + "vile " * 9)], "doc_id long, text string")
    model = fit_severity(docs, spark.createDataFrame([x for x in labels if x[0] < 600], "doc_id long, toxic int"))
    scored = score_severity(docs, model).collect()
    got = {r.doc_id: r for r in scored}
    mean = [np.mean([got[i].severity for i, g in labels if i >= 600 and g == k]) for k in range(4)]
    assert mean[0] < 0.3 and mean[0] < mean[1] < mean[2] < mean[3] and got[2000].toxic and sum(r.doc_id == 5 for r in scored) == 2
    assert all(r.toxic == (r.grade > 0) for r in scored)


def test_fit_is_the_maximum_of_the_likelihood():
    """At the fitted point the slow log-likelihood has no slope, by differences, in any weight or threshold."""
    from tallystream.llm.toxicity import GRADES, _fit

    draw = np.random.default_rng(4)
    n, width, ridge = 120, 3, 0.5
    x = draw.integers(0, 3, (n, width)).astype(float)
    grade = np.clip(np.round(x @ [0.9, -0.4, 0.3] + draw.normal(size=n)), 0, GRADES).astype(int)
    at, cols = np.nonzero(x)
    w, thetas = _fit(at, cols, x[at, cols], grade, width, ridge, 6000)

    def likelihood(p):
        total = -0.5 * ridge * sum(v * v for v in p[:width])
        for row, g in zip(x, grade, strict=True):
            over = [1.0, *(1 / (1 + np.exp(-(row @ p[:width] - t))) for t in p[width:]), 0.0]
            total += np.log(over[g] - over[g + 1])
        return total

    best = np.concatenate([w, thetas])
    slopes = [(likelihood(best + d) - likelihood(best - d)) / 2e-4 for d in 1e-4 * np.eye(len(best))]
    assert list(thetas) == sorted(thetas) and np.abs(slopes).max() < 0.05


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_feistel_is_a_permutation(n):
    slots = feistel(np.arange(n), n, 5)
    assert sorted(slots) == list(range(n)) and (n < 100 or (slots != feistel(np.arange(n), n, 6)).any())


def test_shards(spark):
    texts = ["alpha beta gamma " * k for k in range(0, 60)] + [None, "", "two  spaces\n and  more " * 50, "x" * 3000]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, slot int").repartition(5)
    folder = new_path(spark, "shards")
    manifest = write_shards(rows, folder, length=16, shard_numbers=25).collect()
    assert sorted(r.slot for r in manifest) == list(range(len(manifest))) and len({r.shard for r in manifest}) > 3
    assert [(r.shard, r.position) for r in sorted(manifest, key=lambda r: r.slot)] == sorted((r.shard, r.position) for r in manifest)
    records = list(read_slots(folder, 0, len(manifest), length=16, shard_numbers=25))
    parts = {}
    for r in manifest:
        assert hashlib.md5(records[r.slot].tobytes()).hexdigest() == r.md5
        parts.setdefault((r.doc_id, r.seq), []).append(records[r.slot][: r.n_tokens].tolist())
    for i, t in enumerate(texts):
        ids = codec().encoding.encode_ordinary(t or "")
        copies = 2 if i == 3 else 1
        assert [parts[i, s] for s in range(-(-len(ids) // 16))] == [[ids[k : k + 16]] * copies for k in range(0, len(ids), 16)]
    resumed = list(read_slots(folder, 7, 63, length=16, shard_numbers=25))
    assert [a.tolist() for a in resumed] == [a.tolist() for a in records[7:63]]
    assert all((r.shard, r.position) == divmod(r.slot, 25) for r in manifest)
    again = write_shards(rows, folder, length=16, shard_numbers=25)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest))
    assert write_shards(rows.limit(0), new_path(spark, "shards")).count() == 0


def test_slots_follow_from_the_scan(spark, tmp_path):
    """The sequence with number i of the scan has the slot that the permutation gives i, also of a very long text."""
    texts = ["a b c d " * 9, "long text " * 60_000, None, "tail of it", "a b c d " * 9]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, md5 string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs, folder = spark.read.parquet(str(tmp_path / "d")), new_path(spark, "shards")
    got = {(r.doc_id, r.seq): r.slot for r in write_shards(docs, folder, length=8, seed=3).collect()}
    numbers = [(i, s) for i, t in enumerate(texts) for s in range(-(-len(codec().encoding.encode_ordinary(t or "")) // 8))]
    assert len(numbers) > 15_000 and got == dict(zip(numbers, feistel(np.arange(len(numbers)), len(numbers), 3).tolist(), strict=True))
    assert not [f for f in (tmp_path / "x").parent.glob("**/.shard-*")]


def test_pipeline(spark, tmp_path):
    draw = random.Random(11)
    vocabulary = [f"term{i}" for i in range(900)]
    sentence = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    rows = [(i, sentence(150), "en", f"s{i % 2}", 0) for i in range(200)]
    rows = [(i, t + "\nsubscribe to our newsletter" if i % 3 == 0 else t, *r) for i, t, *r in rows]
    rows += [(300, rows[10][1], "en", "s0", 0), (301, rows[11][1].replace("term1 ", "term2 ", 1) + " tail", "en", "s1", 0)]
    leak = sentence(12)
    rows += [(310, sentence(40) + " " + leak + " " + sentence(40), "en", "s0", 0)]
    rows += [(400 + i, sentence(100) + " vile rotten vile", "en", "s1", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(400 + i, 1, 1) for i in range(25)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(200))
    kept = {i: t.replace("\nsubscribe to our newsletter", "") for i, t, *_ in rows}
    assert all(out[i].decoded_sha256 == hashlib.sha256(kept[i].encode()).hexdigest() for i in out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "bpe_encoding"]


@pytest.mark.parametrize("block", [65536, 700])
def test_every_pair_is_linked_in_a_hot_region(spark, block):
    """All vectors lie around one centre (mutual cosine about 0.7); each second one has a partner of about 0.92."""
    draw = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    n, dim = 6000, 64
    base = unit(np.sqrt(0.7) * unit(draw.standard_normal((1, dim))) + np.sqrt(0.3) * unit(draw.standard_normal((n // 2, dim))))
    x = np.concatenate([base, unit(base + 0.425 * unit(draw.standard_normal((n // 2, dim))))]).astype(np.float32).astype(np.float64)
    near = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_duplicates(rows, block=block).collect()}
    assert [got[i].n_links for i in range(n)] == near.sum(axis=1).tolist() and near.any(axis=1).sum() > n // 2
    assert [got[i].component_id for i in range(n)] == classes(n, np.argwhere(near).tolist())


def grams_of(words):
    return {tuple(words[j : j + 5]) for j in range(len(words) - 4)}


def similar_pair(draw, vocabulary, n, least):
    """Two lists of words whose similarity is the smallest one not under ``least`` that changed words led to."""
    w = [draw.choice(vocabulary) for _ in range(n)]
    v = list(w)
    for _ in range(400):
        u = list(v)
        u[draw.randrange(n)] = draw.choice(vocabulary)
        a, b = grams_of(w), grams_of(u)
        if len(a & b) >= least * len(a | b):
            v = u
        elif draw.random() < 0.2:
            break
    return w, v


@pytest.mark.parametrize("least", [0.8, 0.82, 0.85])
def test_copies_at_the_border_are_found_and_verified(spark, least):
    """All 80 pairs at the border are found (the expected recall is about 0.999), and no pair under 0.8 is linked."""
    draw = random.Random(int(100 * least))
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [x for i in range(80) for x in similar_pair(draw, vocabulary, draw.randrange(60, 400), least)]
    unlike = [x for i in range(40) for x in similar_pair(draw, vocabulary, draw.randrange(100, 400), 0.68)]
    share = lambda i, x: len(grams_of(x[i]) & grams_of(x[i + 1])) / len(grams_of(x[i]) | grams_of(x[i + 1]))
    kept_pairs = [i for i in range(0, len(unlike), 2) if share(i, unlike) < 0.8]
    assert len(kept_pairs) > 30
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + unlike)], "doc_id long, text string")
    for block in (2048, 1):
        got = {r.key: r.component_id for r in near_copies(rows, class_block=block).collect()}
        assert sum(got[i + 1] == i for i in range(0, len(texts), 2)) >= 79
        assert all(got[len(texts) + i + 1] == len(texts) + i + 1 for i in kept_pairs)
    assert sorted(r.doc_id for r in drop_near_duplicates(rows).collect()) == sorted(k for k, c in got.items() if k == c)


@pytest.mark.parametrize("window", [512, 8])
def test_passes_follow_the_order(spark, window, monkeypatch):
    """With a window of 8 of 4,000 rows one round of passes loses pairs at the threshold; those that follow find them."""
    from tallystream.llm import embed_dedup

    draw, n, pairs, dim = np.random.default_rng(3), 4000, 300, 32
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    base = unit(draw.standard_normal((n - pairs, dim)))
    off = unit(draw.standard_normal((pairs, dim)))
    off = unit(off - (off * base[:pairs]).sum(axis=1)[:, None] * base[:pairs])
    share = draw.uniform(0.9005, 0.91, pairs)[:, None]
    x = np.concatenate([base, share * base[:pairs] + np.sqrt(1 - share**2) * off])
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    near = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(near, False)
    found = lambda: {r.vec_id: r for r in embedding_duplicates(rows, window=window, ranks=64 if window == 8 else 4096).collect()}
    got = found()
    assert sum(got[i].n_links for i in range(n)) >= 0.99 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(n))
    if window == 8:
        monkeypatch.setattr(embed_dedup, "_more_passes", lambda *a: 0)
        monkeypatch.setattr(embed_dedup, "_rest", lambda raw, left, n_left, *a: spark.createDataFrame([], "a long, b long"))
        once = found()
        assert sum(once[i].n_links for i in range(n)) < 0.95 * near.sum()


def test_exact_embeddings(spark):
    x = np.random.default_rng(5).standard_normal((600, 3))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_duplicates(rows, exact=True, block=100).collect()}
    assert [got[i].n_links for i in range(600)] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(600)] == classes(600, np.argwhere(near).tolist())


@pytest.mark.parametrize("case", ["odd", "empty", "no labels"])
def test_pipeline_on_odd_tables(spark, tmp_path, case):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing columns, and tables without rows."""
    long = " ".join(f"word{i % 977}q{i % 31}" for i in range(40_000))
    rows = [
        (1, None, "en", "s0", None), (2, "", None, "s0", 0), (3, long, "en", None, 9), (4, long + " tail", "en", "s1", 9), (5, "one text of its own here and no more", "en", "s1", 3), (5, "quite another text under that same id", "en", "s1", 3),
        (6, "a repeated row", "en", "s1", 1), (6, "a repeated row", "en", "s1", 1), (None, "a text without an id", "en", "s1", 1), (None, "a text without an id", "en", "s1", 1), (7, "a leaked line of the test set stands in here for all to see", "en", "s1", 2),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, columns).withColumns({"n_lines": F.lit("x"), "words": F.lit(1), "key": F.lit(2), "node": F.lit(3), "hash": F.lit(4), "severity": F.lit(5), "host": F.lit(6)})
    (docs.limit(0) if case == "empty" else docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "leaked line of the test set stands in here for all"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    labels.filter("false" if case == "no labels" else "true").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = Counter((r.doc_id, r.n_tokens) for r in out)
    size = lambda t: len(codec().encoding.encode_ordinary(t))
    wanted = Counter({(1, 0): 1, (3, size(long)): 1, (5, size(rows[4][1])): 1, (5, size(rows[5][1])): 1, (6, size("a repeated row")): 1, (None, size("a text without an id")): 2})
    assert kept == (Counter() if case == "empty" else wanted)
