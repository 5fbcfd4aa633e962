"""URL filter: path rules, and a Bloom filter cascade for everything they leave open.

Level 0 of the cascade is a Bloom filter of the listed keys; level 1 one of the unlisted keys of the universe that level 0
takes for listed; level 2 one of the listed keys that level 1 takes for unlisted; and so on until a level makes no error.
The first level that rejects a key decides. Since the levels are built over all keys the corpus has, membership is exact
for these, by bit tests alone and without a join. Keys are dealt by hash into shards with a cascade each, so many that no
filter exceeds a bound. The filters of several shards are literals of one expression, as long as they stay within a second
bound together, and every row is tested against its own shard's alone: one pass over the rows for each such group of shards.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.llm.shared import UPPER, LOWER, written

#: Verdict and rule (host, then path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Bits of a key, probes, bits of a filter at most, and bits of all literals of an expression at most.
BITS_PER_KEY, PROBES, MAX_BITS, PASS_BITS = 10, 5, 1 << 22, 1 << 26
#: Share of the unlisted keys that level 0 may take for listed (0.01 is expected), by which shards are sized.
FALSE_SHARE = 0.03


@dataclass
class Cascade:
    """Bloom filters as lists of 64-bit words, by shard and level."""

    shards: int = 1
    levels: list[list[list[int]]] = field(default_factory=list)

    def passes(self, pass_bits: int = PASS_BITS) -> list[range]:
        """Runs of shards whose filters take at most ``pass_bits`` together."""
        cuts, bits = [0], 0
        for s in range(self.shards):
            own = 64 * sum(len(words) for words in (self.levels[s] if s < len(self.levels) else []))
            if bits + own > pass_bits and s > cuts[-1]:
                cuts.append(s)
                bits = 0
            bits += own
        return [range(a, b) for a, b in pairwise([*cuts, self.shards])]

    def contains(self, key: Column, shards: range | None = None) -> Column:
        """Whether a key of the universe is listed; ``key`` must belong to one of the shards. Null is not."""
        shards = shards or range(self.shards)
        levels = [self.levels[s] if s < len(self.levels) else [] for s in shards]
        at = _shard(key, self.shards) - shards.start + 1
        count = F.element_at(F.lit([len(own) for own in levels]), at) if len(levels) > 1 else F.lit(len(levels[0]))
        out = count % 2 == 1
        for level in reversed(range(max(len(own) for own in levels))):
            words = [own[level] if level < len(own) else [0] for own in levels]
            out = F.when((count > level) & ~_hit(key, level, words, at), F.lit(level % 2 == 1)).otherwise(out)
        return key.isNotNull() & out

    def mark(self, rows: DataFrame, key: str, name: str, pass_bits: int = PASS_BITS) -> DataFrame:
        """Add the boolean column ``name``; one pass over the rows for each run of ``passes``."""
        runs = self.passes(pass_bits)
        if len(runs) == 1:
            return rows.withColumn(name, self.contains(F.col(key)))
        shard, out = _shard(F.col(key), self.shards), None
        for run in runs:
            part = rows.filter((shard >= run.start) & (shard < run.stop)).withColumn(name, self.contains(F.col(key), run))
            out = part if out is None else out.unionByName(part)
        return out


def _shard(key: Column, shards: int) -> Column:
    """A null key belongs to some shard too."""
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int")


def _bits(key: Column, level: int, m: Column) -> list[Column]:
    """Double hashing: the bits of a key among ``m`` (long)."""
    first, step = (F.pmod(F.xxhash64(F.lit(2 * level + i), key), m) for i in range(2))
    return [F.pmod(first + step * F.lit(j), m) for j in range(PROBES)]


def _hit(key: Column, level: int, words: list[list[int]], at: Column) -> Column:
    """Whether all bits of a key are set in its filter, the one at place ``at`` (from 1)."""
    held = F.from_json(F.lit(json.dumps([w for own in words for w in own])), "array<bigint>")  # folded to a literal once
    sizes = [len(own) for own in words]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    place = lambda values: F.element_at(F.lit(values), at).cast("long") if len(values) > 1 else F.lit(values[0]).cast("long")
    hit = F.lit(True)
    for bit in _bits(key, level, 64 * place(sizes)):
        hit = hit & (F.getbit(F.element_at(held, (place(starts) + F.shiftright(bit, 6) + 1).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1)
    return hit


def _blooms(keys: DataFrame, level: int, sizes: list[int]) -> list[list[int]]:
    """The filters of all shards, of ``sizes`` words; the driver gets at most one row for each word."""
    m = 64 * (F.element_at(F.lit(sizes), F.col("shard") + 1) if len(sizes) > 1 else F.lit(sizes[0])).cast("long")
    at = keys.select("shard", F.explode(F.array(*_bits(F.col("key"), level, m))).alias("at"))
    rows = at.groupBy("shard", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
    out = [[0] * n for n in sizes]
    for r in rows.collect():
        out[r["shard"]][r["word"]] = r["bits"]
    return out


def build_cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade:
    """The cascade of a table (key string, listed boolean) that holds every key of the corpus once.

    Null keys are left out; without listed keys nothing is a member. ``max_bits`` (1,024 at least) bounds each filter, of listed
    and of unlisted keys: where a level proves larger than expected, the cascade is built again with twice the shards.
    """
    if max_bits < 1024:
        raise ValueError("a filter needs 1,024 bits at least")
    keys = written(universe.filter(F.col("key").isNotNull()), "url-keys")
    n = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    shards = max(1, math.ceil(max(n[0], FALSE_SHARE * n[1]) * BITS_PER_KEY / (0.9 * max_bits)))
    while (made := _levels(keys, shards, max_bits)) is None:
        shards *= 2
    return made


def _levels(keys: DataFrame, shards: int, max_bits: int) -> Cascade | None:
    """The cascade with so many shards; None if a filter would exceed the bound."""
    dealt = keys.withColumn("shard", _shard(F.col("key"), shards))
    encode, test, made, level = dealt.filter("listed"), dealt.filter(~F.col("listed")), Cascade(shards, [[] for _ in range(shards)]), 0
    while counts := {r["shard"]: r["count"] for r in encode.groupBy("shard").count().collect()}:  # a row per shard
        sizes = [math.ceil(counts.get(s, 0) * BITS_PER_KEY / 64) or 1 for s in range(shards)]
        if 64 * max(sizes) > max_bits:
            return None
        filters = _blooms(encode, level, sizes)
        for s in counts:
            made.levels[s].append(filters[s])
        there = F.element_at(F.lit([s in counts for s in range(shards)]), F.col("shard") + 1)
        wrong = test.filter(there & _hit(F.col("key"), level, filters, F.col("shard") + 1))
        encode, test, level = written(wrong, "url-level"), encode, level + 1
    return made


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to / ? or #, A-Z lower-cased) and path (then, up to ? or #); both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    A rule fits its host and all subdomains of it, if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, listed: DataFrame | None = None, *, url: str = "url", key: str = "page_id", max_bits: int = MAX_BITS) -> DataFrame:
    """Judge every url: by the longest rule that fits, else by whether its host is listed.

    ``listed`` has a column ``key`` of hosts to block; by default these are the hosts with a page that the rules block.
    Returns per input row the key, ``host``, ``path``, ``rule``, ``listed`` and ``verdict`` (allow or block). A null url, or
    one without ://, has an empty host and path, as has an empty url; a url of any length is judged whole; repeated rows stay; an
    empty table gives no rows; rules of equal length that fit both have equal text, so none tie; other columns are not read.
    """
    host, path = split_url(F.col(url))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path")).select(key, "host", "path", rule.alias("rule"), verdict.alias("own"))
    if listed is None:
        universe = rows.groupBy(F.col("host").alias("key")).agg(F.bool_or(F.coalesce(F.col("own") == "block", F.lit(False))).alias("listed"))
    else:
        wanted = listed.select("key").distinct().withColumn("there", F.lit(True))
        universe = rows.select(F.col("host").alias("key")).distinct().join(wanted, "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("listed"))
    out = build_cascade(universe, max_bits).mark(rows, "host", "listed")
    return out.select(key, "host", "path", "rule", "listed", F.coalesce("own", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
