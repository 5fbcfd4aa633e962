"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features of a text are its words and their first four to seven letters, by 1 + log(occurrences). One weight vector is shared by all
thresholds: P(grade >= k) = sigmoid(w x - theta_k) with theta_1 < theta_2 < theta_3. The model is fitted on a bounded sample of
labelled rows; of each group of near copies in the sample one stays, so that words of copied documents do not pass for signs
of toxicity. Features count if they stand in toxic rows far more often than by chance, and in a least share of these.

Labels may be grades (0, and 1 to 3 for toxic rows), which are then used as they are. Where labels are only 0 or 1, toxic rows are
graded 1 to 3 across two halves of the sample: each half is graded by the words that the *other* half takes for signs of toxicity,
below, between and above the terciles of how many of them its toxic rows hold, so no row's grade restates its own features. The
result is the expected grade, the sum of P(grade >= k) over k.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.llm.shared import written

#: Labelled rows of the sample and features, at most.
SAMPLE, FEATURES = 12_000, 2_000
GRADES, PREFIXES = 3, (4, 5, 6, 7)
#: Rounds of thinning near copies, and the least share of toxic rows that hold a feature.
THINNINGS, LEAST_SHARE = 5, 0.02
#: P(grade >= 1) from which a document counts as toxic.
TOXIC_FROM = 0.3
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    return Counter(_WORDS.findall((text or "").lower()))


def features_of(words: Counter) -> Counter:
    """Occurrences of each feature: =word, and ^letters for longer words."""
    out: Counter = Counter()
    for word, n in words.items():
        out["=" + word] += n
        for size in PREFIXES:
            if len(word) > size:
                out["^" + word[:size]] += n
    return out


@dataclass(frozen=True)
class SeverityModel:
    """Weights by feature, and the thresholds."""

    weights: dict[str, float]
    thetas: tuple[float, ...]

    @cached_property
    def heads(self) -> frozenset[str]:
        """The first letters that a word with any weight has."""
        return frozenset(f[1 : 1 + PREFIXES[0]] for f in self.weights)

    def margin(self, text: str | None) -> float:
        heads, size = self.heads, PREFIXES[0]
        found = Counter({word: n for word, n in words_of(text).items() if word[:size] in heads})
        return float(sum(w * (1 + log(n)) for f, n in features_of(found).items() if (w := self.weights.get(f)) is not None))

    def exceed(self, margin: float) -> list[float]:
        """P(grade >= k) for each k from 1 on."""
        return [float(1 / (1 + np.exp(-np.clip(margin - t, -40, 40)))) for t in self.thetas]


def _longer(size: int):
    return lambda word: F.length(word) > size


def _head(size: int):
    return lambda word: F.concat(F.lit("^"), F.substring(word, 1, size))


def _sample(docs: DataFrame, labels: DataFrame, sample: int, text: str, key: str, label: str) -> DataFrame:
    """(toxic, words, counts, half): sampled rows with a label (toxic is the grade), near copies left out."""
    import xxhash

    chosen = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("doc")).agg(F.max(F.col(label).cast("int")).alias("toxic")).orderBy(F.xxhash64("doc"), "doc").limit(sample)
    rows = docs.select(F.col(key), F.col(text)).join(F.broadcast(chosen), F.col(key) == F.col("doc")).select("doc", "toxic", text)

    lows = [f"low{i}" for i in range(THINNINGS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                low, words = [[] for _ in range(THINNINGS)], []
                for value in part.column(2):
                    t = value.as_py() or ""
                    parts = t.encode().lower().split()
                    for seed in range(THINNINGS):
                        low[seed].append(min((digest(b" ".join(x), seed) for x in zip(*[parts[i:] for i in range(5)], strict=False)), default=digest(t, seed)) >> 1)
                    words.append(words_of(t))
                cols = [pa.array(v, pa.int64()) for v in low]
                cols += [pa.array([list(w) for w in words], pa.list_(pa.string())), pa.array([list(w.values()) for w in words], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["doc", "toxic", *lows, "words", "counts"])

    schema = f"doc {docs.schema[key].dataType.simpleString()}, toxic int, {' long, '.join(lows)} long, words array<string>, counts array<int>"
    every = written(rows.mapInArrow(run, schema), "severity-rows")
    thin = every.select("doc", *lows)
    for low in lows:
        thin = thin.groupBy(low).agg(F.min_by(F.struct("doc", *lows), F.col("doc")).alias("row")).select("row.*")
    one = every.join(thin.select("doc").distinct(), "doc").groupBy("doc").agg(F.first("toxic").alias("toxic"), F.min_by(F.struct("words", "counts"), F.col("low0")).alias("row"))
    return written(one.select("toxic", "row.*", F.pmod(F.xxhash64(F.lit("half"), "doc"), F.lit(2)).cast("int").alias("half")), "severity-sample")


def fit_severity(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, features: int = FEATURES, text: str = "text", key: str = "doc_id", label: str = "toxic", ridge: float = 0.5, steps: int = 600) -> SeverityModel:
    """Fit on at most ``sample`` labelled rows, those of the smallest hash of the key. Without toxic rows nothing is toxic.

    A key with several labels has the highest of them, grades above 3 count as 3; null labels and keys are left out; features
    of equal weight of evidence are taken in alphabetical order; texts of any length are read whole.
    """
    rows = _sample(docs, labels, sample, text, key, label)
    heads = [F.transform(F.filter("words", _longer(size)), _head(size)) for size in PREFIXES]
    both = F.array_distinct(F.concat(F.transform("words", lambda w: F.concat(F.lit("="), w)), *heads))
    bad = F.when(F.col("toxic") > 0, 1).otherwise(0)
    totals = {r["half"]: (r["n"], r["bad"], r["top"]) for r in rows.groupBy("half").agg(F.count("*").alias("n"), F.sum(bad).alias("bad"), F.max("toxic").alias("top")).collect()}
    n, n_bad = sum(t[0] for t in totals.values()), sum(t[1] for t in totals.values())
    if not n_bad or n_bad == n:
        return SeverityModel({}, tuple(40.0 + k for k in range(GRADES)))
    graded = max(t[2] for t in totals.values()) > 1

    # Evidence of each feature in both halves and the whole; a row for each feature that is one in any of them.
    seen = rows.select("half", bad.alias("bad"), F.explode(both).alias("feature")).groupBy("feature").agg(*[f(F.when(F.col("half") == h, c)).alias(f"{name}{h}") for h in (0, 1) for f, c, name in ((F.count, F.lit(1), "df"), (F.sum, F.col("bad"), "hits"))])
    seen = written(seen.na.fill(0).withColumns({"df": F.col("df0") + F.col("df1"), "hits": F.col("hits0") + F.col("hits1")}).filter("hits >= 3"), "severity-features")
    wanted = {}
    for end, all_rows, bad_rows in [("", n, n_bad), *[(h, *totals[h][:2]) for h in (0, 1) if h in totals]]:
        rate = min(max(bad_rows / all_rows, 1e-9), 1 - 1e-9)
        z = F.try_divide(F.col(f"hits{end}") - rate * F.col(f"df{end}"), F.sqrt(F.col(f"df{end}") * rate * (1 - rate)))  # a half may lack it
        found = seen.withColumn("z", F.coalesce(z, F.lit(0.0))).filter((F.col("z") >= 6) & (F.col(f"hits{end}") >= max(3, LEAST_SHARE * bad_rows)))
        wanted[end] = [r["feature"] for r in found.orderBy(F.desc("z"), "feature").limit(features).select("feature").collect()]
    index = {f: i for i, f in enumerate(wanted[""])}

    firsts = sorted({c[1 : 1 + PREFIXES[0]] for chosen in wanted.values() for c in chosen})
    first_letters = F.array(*[F.lit(f) for f in firsts]) if firsts else F.array().cast("array<string>")
    held = F.filter(F.arrays_zip("words", "counts"), lambda p: F.array_contains(first_letters, F.substring(p["words"], 1, PREFIXES[0])))
    found = rows.select("toxic", "half", held.alias("held")).collect()  # at most ``sample`` short rows
    signs = {h: set(wanted.get(1 - h, ())) for h in (0, 1)}
    at, cols, vals, mass = [], [], [], np.zeros(len(found))
    for i, r in enumerate(found):
        counts = Counter({p["words"]: p["counts"] for p in r["held"]})
        mass[i] = sum(n for word, n in counts.items() if any(f in signs[r["half"]] for f in features_of(Counter([word]))))
        for feature, c in features_of(counts).items():
            if feature in index:
                at.append(i), cols.append(index[feature]), vals.append(1 + log(c))
    grade = np.minimum(np.array([r["toxic"] for r in found]), GRADES)
    if not graded:
        half = np.array([r["half"] for r in found])
        for h in (0, 1):
            mine = (grade > 0) & (half == h)
            if mine.any():
                grade[mine] = 1 + np.searchsorted(np.quantile(mass[mine], [1 / 3, 2 / 3]), mass[mine], side="left")
    weights, thetas = _fit(np.array(at, dtype=np.int64), np.array(cols, dtype=np.int64), np.array(vals), grade, len(index), ridge, steps)
    return SeverityModel({f: float(weights[i]) for f, i in index.items()}, tuple(float(t) for t in thetas))


def _fit(at: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, width: int, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood by Adam, full batch; thresholds are a first one and positive steps."""
    n = len(grade)
    share = np.clip(np.array([(grade >= k).mean() for k in range(1, GRADES + 1)]), 1e-4, 1 - 1e-4)
    first = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, steps + 1):
        w, gaps = p[:width], np.exp(p[width + 1 :])
        thetas = p[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(at, vals * w[cols], minlength=n) if len(at) else np.zeros(n)
        bounds = np.concatenate([[-np.inf], thetas, [np.inf]])
        above, below = sigmoid(bounds[grade + 1] - eta), sigmoid(bounds[grade] - eta)
        chance = np.maximum(above - below, 1e-12)
        g_eta = above + below - 1
        f_above, f_below = above * (1 - above) / chance, below * (1 - below) / chance
        g_theta = np.array([f_above[grade == k].sum() - f_below[grade == k + 1].sum() for k in range(GRADES)])
        g_w = np.bincount(cols, vals * g_eta[at], minlength=width) - ridge * w if len(at) else np.zeros(width)
        g = np.concatenate([g_w, [g_theta.sum()], gaps * np.cumsum(g_theta[::-1])[::-1][1:]]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:width], p[width] + np.concatenate([[0.0], np.cumsum(np.exp(p[width + 1 :]))])


def score_severity(docs: DataFrame, model: SeverityModel, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per input row the key, ``severity`` (expected grade, 0 to 3), ``p_toxic`` (P(grade >= 1)), ``grade`` and ``toxic``.

    ``toxic`` is p_toxic >= TOXIC_FROM; ``grade`` is 0 if not, else 1 and the number of further k with P(grade >= k) >= 0.5. A null
    or empty text has no features; a text of any length is read whole; repeated rows and null keys stay; an empty table gives no
    rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                got = [model.exceed(model.margin(t.as_py())) for t in part.column(1)]
                cols = [pa.array([sum(e) for e in got], pa.float64()), pa.array([e[0] for e in got], pa.float64()), pa.array([(e[0] >= TOXIC_FROM) * (1 + sum(x >= 0.5 for x in e[1:])) for e in got], pa.int32()), pa.array([e[0] >= TOXIC_FROM for e in got], pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], [key, "severity", "p_toxic", "grade", "toxic"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, severity double, p_toxic double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: SeverityModel, *, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model takes for toxic; rows and columns are otherwise unchanged."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keep = [model.exceed(model.margin(t.as_py()))[0] < TOXIC_FROM for t in part.column(at)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
