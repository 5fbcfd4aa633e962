"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is any window of twice a template's words, wherever lines break, so that a notice wrapped over lines is compared whole
and words far apart in a long line are not. A template is found in a block when the block holds at least ``threshold`` of the
template's distinct words. The filters below apply to the document first, then its windows are counted.

Tokens are ordered by how many documents hold them, rarest first, and the words of blocks and templates are sorted by that
order; words that no template has cannot be shared and are left out of the blocks. A block that reaches the threshold must hold
one of the first |T| - need + 1 words of the template (prefix filter) and at least ``need`` words (length filter); from its
first shared word on, both sides must have ``need`` words left (positional filter). A pair is looked at only at its first shared
word of the prefix, so each candidate is verified once. Templates are a parameter of known size, so their index is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.llm.shared import word_array

#: Phrase and label.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Notices as they are usually written, and the label each stands for.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


#: Words of a window, in words of the template: a wrapped notice has further words (names, marks of a comment).
WINDOW = 2


def _need(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _places(parts: list[str], label: str) -> Column:
    """(start, label) of every place where ``parts`` stand consecutively; for texts that have at least so many words."""

    def here(i: Column) -> Column:
        same = F.lit(True)
        for k, part in enumerate(parts):
            same = same & (F.get(F.col("words"), i + (k - 1)) == part)
        return same

    starts = F.filter(F.sequence(F.lit(1), F.size("words") - len(parts) + 1), here)
    return F.transform(starts, lambda i: F.struct((i - 1).cast("long"), F.lit(label))).cast("array<struct<at:bigint,label:string>>")


def token_order(docs: DataFrame, templates: list[tuple[str, str]], text: str = "text") -> list[str]:
    """The templates' words, rarest first by the number of documents that hold them; ties by the word."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    held = docs.select(F.explode(F.array_intersect(word_array(F.col(text)), _strings(vocabulary))).alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # as many rows as the templates have words
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _index(docs: DataFrame, templates: list[tuple[str, str]], threshold: float, order: list[str]) -> tuple[DataFrame, Column]:
    """One row for each word of the templates' prefixes, and all these words."""
    rank, index = {w: i for i, w in enumerate(order)}, []
    for label, text in templates:
        words = sorted(set(text.split()), key=rank.__getitem__)
        need = _need(len(words), threshold)
        index += [(w, label, at, len(words), need, words, words[:at], WINDOW * len(text.split())) for at, w in enumerate(words[: len(words) - need + 1])]
    rows = docs.sparkSession.createDataFrame(index, "word string, label string, at int, size int, need int, tokens array<string>, before array<string>, span int")
    return rows, _strings(sorted({row[0] for row in index}))


def _passes(held: Column, place: Column) -> Column:
    """Positional filter for the word at ``place`` of the block's words and ``at`` of the template's, which is their first one."""
    left = F.least(F.size(held) - place, F.col("size") - F.col("at"))
    return (left >= F.col("need")) & ~F.arrays_overlap(F.col("before"), held)


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.85, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Find phrases and templates in every whole text.

    Returns per input row the key, ``n_words``, ``places`` (sorted starts, in words, of all phrase places), ``base_labels``,
    ``labels`` (sorted arrays; the latter with the templates found) and ``score`` (largest containment of a template found,
    1 where a phrase stands, else 0). A null or empty text has no words and no labels; rows that repeat key and text give as
    many equal rows; null keys are kept; other columns are not read. A block with a template's words in any order counts; a text of
    any length is read whole; templates that tie are all named; an empty table gives no rows.
    """
    order = token_order(docs, templates, text)
    prefixes, seen = _index(docs, templates, threshold, order)
    vocabulary, least = _strings(order), min((_need(len(set(t.split())), threshold) for _, t in templates), default=1)

    base = docs.select(F.col(key), F.xxhash64(F.col(text)).alias("text_hash"), F.lower(text).alias("lower"), F.explode(F.array(word_array(F.col(text)))).alias("words"))
    places = []
    for phrase, label in phrases:
        parts = phrase.split()
        possible = F.lit(True)
        for part in sorted(set(parts), key=len, reverse=True):
            possible = possible & F.contains(F.col("lower"), F.lit(part))
        found = F.when(possible & (F.size("words") >= len(parts)), _places(parts, label))
        places.append(F.coalesce(found, F.array().cast("array<struct<at:bigint,label:string>>")))
    possible = F.arrays_overlap("words", seen)
    # A marker row keeps every document; the other row holds the words of one that may have a template.
    none = F.array().cast("array<array<string>>")
    entries = F.concat(F.array(F.lit(None).cast("array<string>")), F.coalesce(F.when(possible, F.array("words")), none))
    rows = base.select(key, "text_hash", F.size("words").cast("long").alias("n_words"), F.array_sort(F.concat(*places)).alias("places"), F.explode(entries).alias("run"))
    marked = F.col("run").isNull()
    held = F.array_intersect(vocabulary, "run")  # in the global order
    rows = rows.select("*", F.explode(F.array(F.when(~marked, held))).alias("held")).filter(marked | ((F.size("held") >= least) & F.arrays_overlap("held", seen)))
    rows = rows.select("*", F.posexplode_outer(F.when(~marked, F.col("held"))).alias("place", "word")).filter(marked | F.array_contains(seen, F.col("word")))
    pairs = rows.join(F.broadcast(prefixes), (rows["word"] == prefixes["word"]) & _passes(F.col("held"), F.col("place")), "left").drop(prefixes["word"])
    starts = F.filter(F.sequence(F.lit(1), F.size("run")), lambda i: F.array_contains(F.col("tokens"), F.get("run", i - 1)))
    most = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("run", i, F.col("span")), F.col("tokens")))))
    pairs = pairs.withColumn("common", F.when(F.size(F.array_intersect("tokens", "held")) >= F.col("need"), most))
    common = F.col("common")
    good = common >= F.col("need")
    per_doc = pairs.groupBy(key, "text_hash").agg(F.max("n_words").alias("n_words"), F.max("places").alias("places"), F.count_if(marked).alias("copies"), F.collect_set(F.when(good, F.col("label"))).alias("more"), F.max(F.when(good, common / F.col("size"))).alias("best"))
    own = F.array_distinct(F.transform("places", lambda p: p["label"]))
    out = per_doc.select(key, "n_words", F.transform("places", lambda p: p["at"]).alias("places"), F.array_sort(own).alias("base_labels"), F.array_sort(F.array_union(own, "more")).alias("labels"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
